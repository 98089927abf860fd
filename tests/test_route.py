"""X11: sites of different strategies extracted together, each in its mode."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitesift.operators.extract_html import extract_html
from sitesift.operators.route import extract_records
from sitesift.sources.site_schema import load_site_schema


def test_index_and_detail_sites_in_one_pass(spark):
    spec = {".org": {"strategy": "index", "container": "article", "fields": {"title": "h1", "lead": "p"}},
            "example": {"strategy": "detail", "container": "article", "fields": {"title": "h1", "lead": "p"}}}
    cfgs = load_site_schema(spec)
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html")
    got = {(r.page_id, r.ordinal): (r.domain, r.title, r.lead) for r in extract_records(pages, cfgs).collect()}
    want = {}
    for c, mode in zip(cfgs, ("dom", "static")):
        dom = F.when(F.contains("url", F.lit(".org")), F.lit(".org")).otherwise(F.lit("example"))
        own = pages.withColumn("domain", dom).filter(F.col("domain") == c.domain)
        for r in extract_html(own, [c], mode=mode).collect():
            want[(r.page_id, r.ordinal)] = (c.domain, r.title, r.lead)
    assert got == want
    # the two modes really differ on these pages (unclosed <p>)
    assert any(v[0] == ".org" for v in got.values()) and any(v[0] == "example" for v in got.values())
    leads = {dom: {len(v[2]) for v in got.values() if v[0] == dom} for dom in (".org", "example")}
    assert max(leads[".org"]) < max(leads["example"])


def test_the_format_label_never_changes_the_records(spark):
    """The site's strategy picks the parser; labels, leading white space and a
    missing label make no difference."""
    from sitesift.sources.raw import payload_format
    cfgs = load_site_schema({"j.com": {"strategy": "json", "container": "", "fields": {"title": "t"}},
                             "h.com": {"strategy": "detail", "container": "p", "fields": {"title": ""}}})
    bodies = ['[{"t": "a"}]', '\n[{"t": "b"}]', " " * 80 + '{"t": "c"}', "[note] <p>d</p>", "{x} <p>e</p>"]
    rows = [(i, f"https://{'j' if i < 3 else 'h'}.com/{i}", b) for i, b in enumerate(bodies)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(i, t) for i, t in enumerate("abcde")]
    for pages in (plain, plain.withColumn("format", payload_format(F.col("html"))),
                  plain.withColumn("format", F.lit(None).cast("string")), plain.withColumn("format", F.lit("rss"))):
        got = sorted((r.page_id, r.title) for r in extract_records(pages, cfgs).collect())
        assert got == want
    assert [r[0] for r in plain.orderBy("page_id").select(payload_format(F.col("html"))).collect()][:3] == ["json"] * 3
