"""to_silver and publishing on mixed sites, against results worked out by hand."""

import datetime as dt

from sitesift.plans.silver_flow import to_silver
from sitesift.sources.site_schema import load_site_schema

SITES = {
    "a.com": {"dedup_keys": ["title"], "strip_url_query": True},
    "b.com": {"dedup_keys": ["title", "company"]},
}


def test_mixed_sites(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 4)]
    rows = [
        dict(i=1, title="x", company="c", source_url="https://a.com/p?q=1#f", price="$1.50", scraped_at=t[0]),
        dict(i=2, title="x", company="d", source_url="https://a.com/p?q=2", price="N/A", scraped_at=t[1]),
        dict(i=3, title="x", company="c", source_url="https://b.com/p?q=1", price="£2", scraped_at=t[0]),
        dict(i=4, title="x", company="d", source_url="https://b.com/p?q=1", price="3", scraped_at=None),
        dict(i=5, title="x", company=None, source_url="https://b.com/p", price="4", scraped_at=t[2]),
        dict(i=6, title="y", company="c", source_url="https://other.org/p?z=1", price="5", scraped_at=t[0]),
        dict(i=7, title="y", company="c", source_url="https://other.org/p?z=1", price="6", scraped_at=t[2]),
        dict(i=8, title=" n/a ", company="c", source_url="https://a.com/q", price="7", scraped_at=t[2]),
    ]
    schema = "i long, title string, company string, source_url string, price string, scraped_at timestamp"
    df = spark.createDataFrame([tuple(r[c] for c in ["i", "title", "company", "source_url", "price",
                                                       "scraped_at"]) for r in rows], schema)
    out = to_silver(df, load_site_schema(SITES), "2024-02-01", tiebreak=["i"])
    got = sorted((r.i, r.domain, r.source_url, r.price) for r in out.collect())
    # a.com: newest title wins, query cut, "N/A" is no money; b.com: a row without company
    # goes, the query stays; the site without a schema keys on URL and title
    assert got == [(2, "a.com", "https://a.com/p", 0.0), (3, "b.com", "https://b.com/p?q=1", 2.0),
                   (4, "b.com", "https://b.com/p?q=1", 3.0), (7, "general", "https://other.org/p?z=1", 6.0)]
    assert {r.silver_processed_at for r in out.collect()} == {"2024-02-01"}


def test_publish_silver_end_to_end(spark, tmp_out):
    import os
    from sitesift.plans.silver_flow import publish_silver
    from sitesift.sources.silver import read_master, versions
    rows = [(1, "x", "c", "https://a.com/p?q=1", "$1", dt.datetime(2024, 1, 1)),
            (2, "y", "c", "https://b.com/p", "$2", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "i long, title string, company string, source_url string, "
                                     "price string, scraped_at timestamp")
    cfgs = load_site_schema(SITES)
    root, sample = os.path.join(tmp_out, "m"), os.path.join(tmp_out, "s")
    assert publish_silver(df, cfgs, "2024-02-01", root, sample, tiebreak=["i"]) == {"a.com": 1, "b.com": 1}
    assert publish_silver(df, cfgs, "2024-02-01", root, tiebreak=["i"]) == {"a.com": 2, "b.com": 2}
    m, _ = read_master(spark, root)
    assert sorted((r.i, r.source_url) for r in m.collect()) == [(1, "https://a.com/p"), (2, "https://b.com/p")]
    assert spark.read.option("header", True).csv(sample).count() == 2
    assert sorted(len(v) for v in versions(spark, root).values()) == [2, 2]


def test_publish_silver_uses_each_sites_keys(spark, tmp_out):
    import os
    from sitesift.plans.silver_flow import publish_silver
    from sitesift.sources.silver import read_master
    sch = "i long, title string, company string, source_url string, price string, scraped_at timestamp"
    first = spark.createDataFrame([(1, "x", "c1", "https://a.com/1", "$1", dt.datetime(2024, 1, 1))], sch)
    # a.com is keyed on title alone: the same title with another company replaces the row
    second = spark.createDataFrame([(2, "x", "c2", "https://a.com/2", "$2", dt.datetime(2024, 1, 2))], sch)
    cfgs = load_site_schema(SITES)
    root = os.path.join(tmp_out, "m")
    publish_silver(first, cfgs, "2024-02-01", root, tiebreak=["i"], buckets=4)
    publish_silver(second, cfgs, "2024-02-02", root, tiebreak=["i"], buckets=4)
    m, _ = read_master(spark, root)
    assert [(r.i, r.company) for r in m.collect()] == [(2, "c2")]


SHAPES = {
    "shop.com": {"fields": {"title": "h2", "price": ".p"}},
    "jobs.com": {"fields": {"job_title": "h2", "salary": ".s", "company": ".c"}},
    "news.com": {"fields": {"text": "p"}, "strip_url_query": True},
}


def test_each_site_uses_its_own_columns(spark):
    """Sites of three shapes in one frame: each keys on its own title column
    and has its own money column."""
    rows = [(1, "https://jobs.com/l", None, None, "Dev", "$90,000", "c", None), (2, "https://jobs.com/l", None, None, "Ops", "n/a", "c", None),
            (3, "https://shop.com/l", "Tea", "£1.50", None, None, None, None), (4, "https://shop.com/l", "Tea", "2", None, None, None, None),
            (5, "https://news.com/l?x", None, None, None, None, None, "one"), (6, "https://news.com/l", None, None, None, None, None, "two"),
            (7, "https://else.org/", "t", "3", None, None, None, None)]
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, r[0])) for r in rows],
                               "i long, source_url string, title string, price string, job_title string, salary string, "
                               "company string, text string, scraped_at timestamp")
    out = to_silver(df, load_site_schema(SHAPES), "2024-02-01", tiebreak=["i"])
    got = sorted((r.i, r.domain, r.source_url, r.price, r.salary) for r in out.collect())
    assert got == [(1, "jobs.com", "https://jobs.com/l", None, 90000.0), (2, "jobs.com", "https://jobs.com/l", None, 0.0),
                   (4, "shop.com", "https://shop.com/l", 2.0, None), (5, "news.com", "https://news.com/l", None, None),
                   (6, "news.com", "https://news.com/l", None, None), (7, "general", "https://else.org/", 3.0, None)]


def test_number_columns_are_not_read_as_text(spark):
    df = spark.createDataFrame([("https://a.com/p", "x", 12345678.9, dt.datetime(2024, 1, 1))],
                               "source_url string, title string, price double, scraped_at timestamp")
    assert [r.price for r in to_silver(df, load_site_schema(SITES), "2024-02-01").collect()] == [12345678.9]


def test_master_and_sample_keep_every_sites_columns(spark, tmp_out):
    import os
    from sitesift.plans.silver_flow import publish_silver
    from sitesift.sources.silver import read_master
    root, sample = os.path.join(tmp_out, "m"), os.path.join(tmp_out, "s")
    cfgs = load_site_schema(SHAPES)
    when = dt.datetime(2024, 1, 1)
    shop = spark.createDataFrame([("https://shop.com/1", "Tea", "1", when)], "source_url string, title string, price string, scraped_at timestamp")
    jobs = spark.createDataFrame([("https://jobs.com/1", "Dev", "$5", "c", when)],
                                 "source_url string, job_title string, salary string, company string, scraped_at timestamp")
    more = spark.createDataFrame([("https://jobs.com/2", "Ops", "c", when)], "source_url string, job_title string, company string, scraped_at timestamp")
    for batch in (shop, jobs, more):
        publish_silver(batch, cfgs, "2024-02-01", root, sample)
    m, _ = read_master(spark, root)
    assert sorted((r.source_url, r.price, r.salary) for r in m.collect()) == [
        ("https://jobs.com/1", None, 5.0), ("https://jobs.com/2", None, None), ("https://shop.com/1", 1.0, None)]
    day = spark.read.option("header", True).csv(sample)         # both runs of the day
    assert sorted(r.source_url for r in day.collect()) == ["https://jobs.com/1", "https://jobs.com/2", "https://shop.com/1"]
