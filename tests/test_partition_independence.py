"""Results do not depend on the number of shuffle partitions (explicit
tie-breaks everywhere, exact decimal means)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from scripts.oracle_check import digest

NAMES = ["dedup_first", "dedup_newest", "merge_history", "snapshot_merge", "silver_records",
         "keywords_top", "keywords_low", "keyword_pairs", "entity_concentration", "data_gaps",
         "price_distribution", "crawl_halt", "crawl_run", "limit_per_site", "to_fetch"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_16_partitions(spark, name):
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            results.append(digest(E.queries()[name](spark, SF_SMALL).toPandas()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
