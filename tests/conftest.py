import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sitesift.session import local_session
    s = local_session(8, shuffle_partitions=8, app="sitesift-tests")
    yield s


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="sitesift-test-")


def html_records(spark, html, url, cfg, mode):
    """The field values of each record of one page, through the HTML job."""
    from sitesift.operators.extract_html import extract_html
    page = spark.createDataFrame([(1, url, html, cfg.domain)], "page_id long, url string, html string, domain string")
    rows = extract_html(page, [cfg], mode=mode).orderBy("ordinal").collect()
    return [[r[n] for n in cfg.field_names] for r in rows]
