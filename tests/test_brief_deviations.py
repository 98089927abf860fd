"""A12 brief tables and the deliberate deviations listed in the README."""

import os

from pyspark.sql import functions as F

from conftest import html_records
from sitesift.operators import analytics as A
from sitesift.operators import validate as V
from sitesift.operators.extract_html import links_from_html
from sitesift.operators.route import stamp
from sitesift.sources.site_schema import load_site_schema


def records(spark):
    rows = [("shop.a", f"Item {i} red shoe", f"${10 + i}.00", f"brand{i % 3}", f"https://a/{i}")
            for i in range(30)] + [("shop.a", "Item huge red boot", "$9999.00", "brand0", "https://a/x"),
                                   ("shop.b", "blue hat", "N/A", None, "https://b/1")]
    return spark.createDataFrame(rows, "domain string, text string, price string, company string, "
                                       "source_url string")


def test_market_brief_tables(spark, tmp_out):
    tables = A.market_brief(records(spark), "domain", entity_col="company")
    assert set(tables) == {"price_distribution", "keywords", "concentration", "anomalies_and_gaps"}
    pd_ = {r.domain: r for r in tables["price_distribution"].collect()}
    assert pd_["shop.a"].n_valid == 31 and pd_["shop.b"].n_valid == 0 and pd_["shop.b"].mean_value is None
    kinds = {r.kind for r in tables["keywords"].collect()}
    assert kinds == {"dominant", "low_density"}
    gaps = tables["anomalies_and_gaps"]
    assert gaps.filter("kind = 'outlier'").count() == 1
    A.write_brief(tables, os.path.join(tmp_out, "brief"))
    back = spark.read.parquet(os.path.join(tmp_out, "brief", "concentration"))
    assert back.count() == 1  # shop.b has no entity at all


def test_cache_flag_instead_of_cached_text(spark):
    df = spark.createDataFrame([("t", None)], "title string, scraped_at timestamp")
    out = stamp(df, fetched_at=F.lit("2024-01-01 00:00:00").cast("timestamp"), from_cache=F.lit(True))
    r = out.collect()[0]
    assert r.from_cache is True and str(r.scraped_at) == "2024-01-01 00:00:00"
    keep = stamp(spark.createDataFrame([("t", "2023-05-05 00:00:00")], "title string, scraped_at string")
                 .withColumn("scraped_at", F.col("scraped_at").cast("timestamp")),
                 fetched_at=F.lit("2024-01-01").cast("timestamp"), overwrite=False).collect()[0]
    assert str(keep.scraped_at) == "2023-05-05 00:00:00"


def test_none_primary_key_is_malformed(spark):
    df = spark.createDataFrame([(None, None, None)], "title string, link string, company string")
    assert V.soft_validate(df, "title").count() == 0


def test_missing_text_is_no_token(spark):
    df = spark.createDataFrame([(None,), ("nan alpha",)], "text string")
    assert {r.word for r in A.keyword_counts(df, "text").collect()} == {"nan", "alpha"}
    df2 = spark.createDataFrame([(None,)], "text string")
    assert A.keyword_counts(df2, "text").count() == 0


def test_every_container_part_is_scoped_for_links():
    html = '<div class="x"><a href="/in-x">1</a></div><p><a href="/in-p">2</a></p><a href="/out">3</a>'
    assert links_from_html(html, "http://h/", "div.x, p") == ["http://h/in-x", "http://h/in-p"]


def test_class_attribute_is_raw_text(spark):
    cfg = load_site_schema({"s": {"container": "div", "fields": {"cls": {"attribute": "class"}}}})[0]
    assert html_records(spark, '<div class="a b">x</div>', "u", cfg, "static") == [["a b"]]


def test_feed_element_does_not_switch_a_detail_page(spark):
    cfg = load_site_schema({"s": {"container": "div.item", "fields": {"t": "span.t"}}})[0]
    html = '<body><feed></feed><div class="item"><span class="t">A</span></div></body>'
    assert html_records(spark, html, "u", cfg, "static") == [["A"]]


def test_absolute_links_are_not_percent_encoded():
    assert links_from_html('<body><a href="/für">x</a></body>', "http://h/p", "body") == ["http://h/für"]


def test_domains_sharing_a_first_label_keep_separate_masters(spark, tmp_out):
    from sitesift.sources import silver
    root = os.path.join(tmp_out, "m")
    b = spark.createDataFrame([("shop.a.com", "k", 1), ("shop.b.com", "k", 1)], "domain string, k string, ts int")
    published, _ = silver.merge_into_master(spark, root, b, ["domain", "k"], ts_col="ts")
    assert published == {"shop.a.com": 1, "shop.b.com": 1}
    m, _ = silver.read_master(spark, root)
    assert m.count() == 2
