"""Derived inputs for the query catalogue, built by Spark from the given tables.

Each builder reads a driver table and derives a frame whose size grows with
it (no made-up rows). ``catalog.py`` holds the DuckDB twin of every builder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joins import spread
from .sources.silver import _fs, part_dir
from .sources.site_schema import load_site_schema

RUN_TS = "2024-02-01 00:00:00"
SPLIT_HISTORY_BEFORE = "2024-01-20 00:00:00"
SPLIT_BATCH_FROM = "2024-01-15 00:00:00"

# Site schemas used by the catalogue (configuration, not data).
PAGE_SITE = {
    "example": {
        "strategy": "detail",
        "container": "body",
        "fields": {
            "title": "h1",
            "ad": "div.ad",
            "first_link": {"selector": "nav a", "attribute": "href"},
            "heading": ["h2", "h1"],
            "price": "span.price",
            "footer": "footer",
        },
        "strip_url_query": True,
        "dedup_keys": ["title", "source_url"],
    }
}
ARTICLE_SITE = {"example": {"strategy": "detail", "container": "article", "fields": {"title": "h1"}}}
ARTICLE_TEXT_SITE = {"example": {"strategy": "detail", "container": "article",
                                 "fields": {"title": "h1", "text": "p"},
                                 "dedup_keys": ["title", "source_url"]}}
DOM_SITE = {"example": {"strategy": "index", "container": "div.ad, article",
                        "fields": {"title": "h1", "body_text": ""}}}
# Overlapping keys: one exact host, a substring that also covers part of the
# next key's hosts, and keys that match nothing exactly.
RESOLVE_SITES = {
    "thther.example.org": {"strategy": "detail"},
    "example.net": {"strategy": "detail"},
    "blog.": {"strategy": "detail"},
    "cheap-pills": {"strategy": "detail"},
}
ORDER_SITE = {"api.example.com": {
    "strategy": "json", "container": "order.lines",
    "fields": {"line": "n", "part": "part", "qty": "qty", "flag": "flag",
               "status_tag": "tags.1", "last_tag": "tags.-1", "missing": "nope.0"}}}
FEED_SITE = {"feeds.example.com": {
    "strategy": "rss", "container": "item",
    "fields": {"title": "title", "link": "link", "description": "description"}}}
SILVER_SITE = {"example.com": {
    "strategy": "detail", "strip_url_query": True, "dedup_keys": ["title", "company"],
    "fields": {"title": "h1", "company": ".company", "link": {"selector": "a", "attribute": "href"}}}}


def sites(spec: dict):
    return load_site_schema(spec)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread over the task slots when its file is too small
    to scan in parallel (a no-op for large multi-file tables)."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _blank(k: Column, value: Column) -> Column:
    return (F.when(k == 0, F.lit("")).when(k == 1, F.lit("N/A"))
            .when(k == 2, F.lit(None).cast("string")).when(k == 3, F.lit(" none "))
            .otherwise(value))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped-looking records from ``documents``: title/link/company blanked
    by ``doc_id`` modulo 7 (empty, N/A, NULL, ' none '), a source URL with
    query and fragment, a price text and a scrape time (some missing)."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ts = F.expr("timestampadd(HOUR, doc_id % 97, TIMESTAMP_NTZ'2024-03-01 00:00:00')")
    return d.select(
        i.alias("doc_id"),
        F.col("source"),
        F.col("lang"),
        _blank(i % 7, F.col("text")).alias("title"),
        F.col("text"),
        _blank((i / 7).cast("long") % 7,
               F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/doc/"), i.cast("string")))
        .alias("link"),
        _blank((i / 49).cast("long") % 7, F.col("source")).alias("company"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/list?page="),
                 (i % 5).cast("string"), F.lit("#"), F.col("lang")).alias("source_url"),
        F.when(i % 5 == 0, F.lit("N/A"))
        .otherwise(F.concat(F.lit("€"), F.col("n_chars").cast("string"), F.lit("."),
                            F.lpad((i % 100).cast("string"), 2, "0"))).alias("price"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(ts).alias("scraped_at"),
    )


def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money strings from ``part``: £/$ with thousands separators, and by
    ``p_partkey % 11`` the broken forms N/A, 1.2.3, '' and -5."""
    p = table(spark, sf_dir, "part")
    amount = F.col("p_retailprice").cast("decimal(12,2)") * F.col("p_size")
    k = F.col("p_partkey") % 11
    cur = F.when(F.col("p_partkey") % 2 == 0, F.lit("£")).otherwise(F.lit("$"))
    text = (F.when(k == 0, F.lit("N/A")).when(k == 1, F.lit("1.2.3")).when(k == 2, F.lit(""))
            .when(k == 3, F.lit("-5")).otherwise(F.concat(cur, F.format_number(amount, 2))))
    return p.select("p_partkey", "p_brand", text.alias("price_text"))


def order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads (``to_json``) of orders with their lines: one payload
    per order and block of 8 line numbers, so a payload's list is bounded by
    the block size whatever an order's size (TPC-H orders have at most 7
    lines, so every order is one block here).

    By ``o_orderkey % 10``: 0 -> the container is a single object (first
    line), 1 -> JSON null, 2 -> a broken payload; orders without lines have
    an empty list.
    """
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("tags"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey"),
                       (F.col("l_linenumber") / 8).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(line)).alias("lines"))
    j = o.join(lines, "o_orderkey", "left")
    k = F.col("o_orderkey") % 10
    lines_json = F.coalesce(F.to_json(F.col("lines")), F.lit("[]"))
    container = (F.when(k == 0, F.coalesce(F.to_json(F.element_at("lines", 1)), F.lit("null")))
                 .when(k == 1, F.lit("null")).otherwise(lines_json))
    body = F.concat(F.lit('{"order": {"key": '), F.col("o_orderkey").cast("string"),
                    F.lit(', "status": "'), F.col("o_orderstatus"), F.lit('", "lines": '),
                    container, F.lit("}}"))
    body = F.when(k == 2, F.concat(F.lit('{"order": '), body)).otherwise(body)
    return j.select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("https://api.example.com/orders/"), F.col("o_orderkey").cast("string"),
                 F.lit("?block="), F.coalesce(F.col("block"), F.lit(0)).cast("string")).alias("url"),
        body.alias("html"))


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def feed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS bodies from ``documents``: one feed per 8 consecutive doc ids
    (a bounded group), every 11th feed (``feed_id % 11 == 5``) malformed."""
    d = table(spark, sf_dir, "documents")
    item = F.struct(
        F.col("doc_id"),
        F.concat(F.lit("<item><title>"), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"),
                 F.lit("</title><link>https://feeds.example.com/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit("</link><description>"),
                 _xml_escape(F.col("text")), F.lit("</description></item>")).alias("xml"))
    feeds = d.groupBy((F.col("doc_id") / 8).cast("long").alias("feed_id")).agg(
        F.sort_array(F.collect_list(item)).alias("items"))
    inner = F.array_join(F.transform("items", lambda x: x["xml"]), "")
    body = F.concat(F.lit("<rss><channel><title>feed</title>"), inner,
                    F.when(F.col("feed_id") % 11 == 5, F.lit("")).otherwise(F.lit("</channel></rss>")))
    return feeds.select(
        F.col("feed_id").alias("page_id"),
        F.concat(F.lit("https://feeds.example.com/feed/"), F.col("feed_id").cast("string")).alias("url"),
        body.alias("html"))


def events_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """History (before the 20th, with props) and batch (from the 15th,
    without props): five days of identical rows on both sides."""
    e = table(spark, sf_dir, "events")
    hist = e.filter(F.col("ts") < F.lit(SPLIT_HISTORY_BEFORE).cast("timestamp_ntz"))
    batch = (e.filter(F.col("ts") >= F.lit(SPLIT_BATCH_FROM).cast("timestamp_ntz"))
             .select("event_id", "ts", "user_id", "event_type", "value"))
    return hist, batch


def page_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense site x page grid: user = site, day of month 1-30 = page,
    purchases that day = items (zero filled)."""
    e = table(spark, sf_dir, "events")
    sites_ = e.select(F.col("user_id").alias("site")).distinct()
    grid = sites_.select("site", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("page"))
    bought = (e.filter(F.col("event_type") == "purchase")
              .groupBy(F.col("user_id").alias("site"), F.dayofmonth("ts").alias("page"))
              .agg(F.count(F.lit(1)).alias("items")))
    return (grid.join(bought, ["site", "page"], "left")
            .select("site", "page", F.coalesce("items", F.lit(0)).cast("long").alias("items")))


PAGE_PATTERN = "{base_clean}/page/{i}/"
N_PAGES = 3


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.crawl import page_frontier, with_url_hash
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return with_url_hash(page_frontier(pages, N_PAGES, pattern=PAGE_PATTERN))


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log: two copies of every frontier URL, fetched at the times of
    events ``3*page_id + page_no`` and ``+1``."""
    fr = frontier(spark, sf_dir).select("page_id", "page_no", "url_hash")
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    copies = fr.select("url_hash", F.explode(F.array(
        F.col("page_id") * 3 + F.col("page_no"), F.col("page_id") * 3 + F.col("page_no") + 1)).alias("event_id"))
    return copies.join(e, "event_id").select("url_hash", F.col("ts").alias("fetched_at"))


def damage_part(spark: SparkSession, root: str, domain: str, version: int) -> None:
    """Overwrite the files of a committed master part with something else."""
    fs, _, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{part_dir(domain, 0)}/v={version}")
    for st in fs.listStatus(path):
        if st.getPath().getName().endswith(".parquet"):
            out = fs.create(st.getPath(), True)
            out.write(bytearray(b"damaged"))
            out.close()


def start_part(spark: SparkSession, root: str, domain: str, version: int) -> None:
    """A part's folder as a writer leaves it that dies before its commit."""
    fs, _, jvm = _fs(spark, root)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/{part_dir(domain, 0)}/v={version}"))
