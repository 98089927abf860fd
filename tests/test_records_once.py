"""Landed pages are made once, and numbers are read only of
texts that look like numbers in exponent form."""

from pyspark.sql import functions as F

from sitesift.functions.jsonpath import json_path, variant_text
from sitesift.operators.route import extract_records
from sitesift.sources.site_schema import load_site_schema

SITES = {
    "api.example.com": {"strategy": "json", "container": "rows", "fields": {"title": "t"}},
    "feeds.example.com": {"strategy": "rss", "container": "item", "fields": {"title": "title"}},
    "www.example.net": {"strategy": "detail", "container": "body", "fields": {"title": "h1"}},
}


def test_routed_pages_are_made_once(spark, tmp_out):
    pages = [(1, "https://api.example.com/a", '{"rows": [{"t": "x"}, {"t": "y"}]}'),
             (2, "https://feeds.example.com/f", "<rss><channel><item><title>z</title></item></channel></rss>"),
             (3, "https://www.example.net/p", "<body><h1>h</h1></body>"), (4, "https://other.test/", "{}"), (5, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_out}/pages")
    out = extract_records(spark.read.parquet(f"{tmp_out}/pages"), load_site_schema(SITES))
    assert sorted((r.page_id, r.ordinal, r.title) for r in out.collect()) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (3, 0, "h")]
    read = out.inputFiles()
    assert read and not any(f.startswith(f"file://{tmp_out}") for f in read)


def test_numbers_are_read_of_exponent_texts_only(spark):
    text = variant_text(F.col("v").cast("variant"))
    assert "double" not in text._jc.toString().split("THEN")[0].lower()
    rows = [('"1.0E7"', "1.0E7"), ("1e7", "10000000.0"), ("1.5e-3", "0.0015"), ("1e20", "1.0E20"), ("12", "12"), ('"N"', "N"),
            ("true", "true"), ("null", None), ('{"b":1,"a":2}', '{"a":2,"b":1}'), ("[1,2]", "[1,2]")]
    df = spark.createDataFrame([(i, '{"x": %s}' % r[0]) for i, r in enumerate(rows)], "i int, body string")
    v = json_path(F.call_function("try_parse_json", F.col("body")), "x")
    assert [r.t for r in df.select("i", variant_text(v).alias("t")).orderBy("i").collect()] == [r[1] for r in rows]
