"""Plan shape checks on every registered query."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sitesift.catalog import QUERIES

PYTHON_OK = {"html_h1", "html_records", "html_dom_records", "html_links", "rss_records",
             "stream_merge", "records_route", "record_counts", "crawl_records", "to_fetch"}
SKIP = {"stream_merge", "stream_dedup", "stream_crawl_halt", "stream_routed"}  # executed by their own tests


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        assert "MapInPandas" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_resolve_is_a_projection(spark):
    plan = E.queries()["resolve_site"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # one projection: no join and no hash shuffle (the round-robin spread of
    # the single-file fixture is the only exchange)
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_scan_prunes_columns(spark):
    plan = E.queries()["url_netloc"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_filter_pushed_to_scan(spark):
    plan = E.queries()["merge_history"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "word", "n"] and 0 < len(rows) <= 5
