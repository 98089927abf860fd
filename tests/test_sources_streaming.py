"""S1-S6 sinks/sources and R1/R2 streaming (batch = stream)."""

import json
import os
import shutil

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitesift import fixtures as fx
from sitesift.sources import raw, silver
from sitesift.sources.site_schema import load_site_schema, site_schema_df
from sitesift.streaming.ingest import dedup_stream, page_records, run_to_master


def test_site_schema_spellings(spark, tmp_out):
    spec = {"a.com": {"strategy": "index", "container": "div.c",
                      "fields": {"t": "h1, h2", "l": ["a.x", "a.y"], "h": {"selector": "a", "attribute": "href"},
                                 "self": {"attribute": "data-id"}},
                      "dedup_keys": ["t"], "strip_url_query": True},
            "b.com": {}}
    path = os.path.join(tmp_out, "schema.json")
    with open(path, "w") as fh:
        json.dump(spec, fh)
    for src in (spec, json.dumps(spec), path):
        cfgs = load_site_schema(src)
        assert [c.domain for c in cfgs] == ["a.com", "b.com"] and cfgs[1].strategy == "detail"
        f = {r.name: r for r in cfgs[0].fields}
        assert f["t"].selectors == ("h1", "h2") and f["l"].selectors == ("a.x", "a.y")
        assert f["h"].attribute == "href" and f["self"].selectors == ()
        assert cfgs[0].primary_key == "t"
    df = site_schema_df(spark, load_site_schema(spec))
    assert df.count() == 2 and df.schema["fields"].dataType.elementType.names == ["name", "selectors", "attribute"]


def test_raw_layer_write_and_prune(spark, tmp_out):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    fetched = F.expr("timestampadd(HOUR, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    r = raw.landed_to_raw(pages, fetched)
    path = os.path.join(tmp_out, "raw")
    raw.write_raw(r, path)
    back = raw.read_raw(spark, path)
    assert back.count() == pages.count()
    one = back.filter(F.col("netloc") == r.first().netloc)
    assert "PartitionFilters: [isnotnull(netloc" in one._jdf.queryExecution().executedPlan().toString()
    assert set(back.columns) == set(raw.RAW_COLUMNS)


def test_master_versions_and_bad_version(spark, tmp_out):
    root = os.path.join(tmp_out, "master")
    sch = "domain string, k string, ts int, v string"
    b1 = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 1, "y"), ("e", "a", 1, "e1")], sch)
    b2 = spark.createDataFrame([("d", "a", 2, "x2")], sch)
    p1, _ = silver.merge_into_master(spark, root, b1, ["domain", "k"], ts_col="ts")
    p2, _ = silver.merge_into_master(spark, root, b2, ["domain", "k"], ts_col="ts")
    assert p1 == {"d": 1, "e": 1} and p2 == {"d": 2}  # only the touched domain is rewritten
    m, problems = silver.read_master(spark, root)
    assert sorted((r.domain, r.k, r.v) for r in m.collect()) == [("d", "a", "x2"), ("d", "b", "y"),
                                                                 ("e", "a", "e1")] and problems == []
    silver.merge_into_master(spark, root, b2, ["domain", "k"], ts_col="ts")  # same batch twice
    m3, _ = silver.read_master(spark, root)
    assert sorted((r.domain, r.k, r.v) for r in m3.collect()) == sorted((r.domain, r.k, r.v) for r in m.collect())
    # an uncommitted folder and an unreadable version of "d" are skipped
    ddir = os.path.join(root, silver.part_dir("d", 0))
    os.makedirs(os.path.join(ddir, "v=9"))
    bad = os.path.join(ddir, "v=8")
    os.makedirs(bad)
    open(os.path.join(bad, "part-0.parquet"), "w").write("not parquet")
    open(os.path.join(bad, "_SUCCESS"), "w").close()
    m4, problems = silver.read_master(spark, root)
    assert len(problems) == 2
    assert sorted((r.domain, r.k, r.v) for r in m4.collect()) == sorted((r.domain, r.k, r.v) for r in m.collect())
    only_e, _ = silver.read_master(spark, root, ["e"])
    assert [r.v for r in only_e.collect()] == ["e1"]


def test_bucketed_master_rewrites_only_touched_parts(spark, tmp_out):
    from sitesift.operators.merge import merge_history
    root = os.path.join(tmp_out, "bm")
    sch = "domain string, k string, ts int, v string"
    base = spark.createDataFrame([("big", f"k{i}", 1, "old") for i in range(200)], sch)
    small = spark.createDataFrame([("big", "k3", 2, "new"), ("big", "k150", 2, "new")], sch)
    p1, _ = silver.merge_into_master(spark, root, base, ["domain", "k"], ts_col="ts", buckets=8)
    assert len(p1) == 8 and set(p1.values()) == {1}
    p2, _ = silver.merge_into_master(spark, root, small, ["domain", "k"], ts_col="ts", buckets=99)
    assert 1 <= len(p2) <= 2 and set(p2.values()) == {2}        # two keys touch at most two parts
    assert silver.layout_buckets(spark, root) == 8                # fixed when the master was created
    m, _ = silver.read_master(spark, root)
    want = merge_history(base, small, ["domain", "k"], "ts")
    assert sorted(map(tuple, m.select("domain", "k", "ts", "v").collect())) == \
        sorted(map(tuple, want.select("domain", "k", "ts", "v").collect()))


def test_sample_csv_and_checkpoint(spark, tmp_out):
    df = spark.createDataFrame([("d", "t1", "2024-01-01", "x"), ("d", "t1", "2024-01-02", "x")],
                               "domain string, title string, scraped_at string, silver_processed_at string")
    path = os.path.join(tmp_out, "sample")
    silver.write_sample(df, path, "2024-02-01")
    back = spark.read.option("header", True).csv(path)
    assert set(back.columns) == {"title", "domain", "snapshot_date"} and back.count() == 2
    ck = silver.save_checkpoint(df.withColumn("arrival", F.lit(1)), os.path.join(tmp_out, "ck"), ["arrival"])
    assert ck.count() == 1


def split_pages(spark, out_dir, n=4):
    t = pq.read_table(f"{SF_SMALL}/pages.parquet")
    os.makedirs(out_dir, exist_ok=True)
    step = (t.num_rows + n - 1) // n
    for i in range(n):
        pq.write_table(t.slice(i * step, step), os.path.join(out_dir, f"pages-{i}.parquet"))


def test_stream_equals_batch(spark, tmp_out):
    src = os.path.join(tmp_out, "landing")
    split_pages(spark, src)
    cfgs = fx.sites(fx.PAGE_SITE)
    master = run_to_master(spark, src, os.path.join(tmp_out, "m"), os.path.join(tmp_out, "ck"), cfgs,
                           ["source_url", "ordinal"])
    batch = page_records(spark.read.parquet(f"{SF_SMALL}/pages.parquet"), cfgs)
    cols = ["page_id", "ordinal", "title", "ad", "first_link", "footer"]
    assert sorted(tuple(r) for r in master.select(cols).collect()) == \
        sorted(tuple(r) for r in batch.select(cols).collect())
    vs = silver.versions(spark, os.path.join(tmp_out, "m"))
    assert [len(v) for v in vs.values()] == [4]  # one domain, one version per micro-batch


def test_stream_reports_validation_metrics(spark, tmp_out):
    from sitesift.streaming.ingest import stream_to_master
    src = os.path.join(tmp_out, "landing2")
    split_pages(spark, src, 2)
    q = stream_to_master(spark, src, os.path.join(tmp_out, "m2"), os.path.join(tmp_out, "ck3"),
                         fx.sites(fx.PAGE_SITE), ["source_url", "ordinal"])
    q.awaitTermination()
    seen = [p["observedMetrics"]["validation"] for p in q.recentProgress
            if p.get("observedMetrics", {}).get("validation")]
    assert sum(m["n_records"] for m in seen) == spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()


def test_stream_dedup_first_per_key(spark, tmp_out):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL))
    out = dedup_stream(ev, ["user_id", "event_type"], "ts")
    q = (out.writeStream.format("memory").queryName("dedup_test").option(
        "checkpointLocation", os.path.join(tmp_out, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT * FROM dedup_test")
    keys = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", "event_type").distinct().count()
    assert got.count() == keys == got.select("user_id", "event_type").distinct().count()


def test_read_raw_files_layout(spark, tmp_out):
    root = os.path.join(tmp_out, "bronze")
    os.makedirs(os.path.join(root, "shop.com", "2024-05-01"))
    with open(os.path.join(root, "shop.com", "2024-05-01", "0123456789abcdef_134501.html"), "w") as fh:
        fh.write("<html><body><rss>x</rss></body></html>")
    with open(os.path.join(root, "shop.com", "2024-05-01", "fedcba9876543210_090000.json"), "w") as fh:
        fh.write('{"a": 1}')
    got = {r.url_hash: r for r in raw.read_raw_files(spark, root).collect()}
    assert set(got) == {"0123456789abcdef", "fedcba9876543210"}
    a = got["0123456789abcdef"]
    assert (a.netloc, str(a.fetch_date), str(a.fetched_at), a.format) == \
        ("shop.com", "2024-05-01", "2024-05-01 13:45:01", "rss")
    assert got["fedcba9876543210"].format == "json"


def test_custom_parser_route(spark):
    import pandas as pd
    from sitesift.operators.route import extract_with

    def parser(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pdf["page_id"], "n_chars": pdf["html"].str.len()})

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    out = extract_with(pages, parser, "page_id long, n_chars long", columns=["page_id", "html"])
    want = {r.page_id: r.n for r in pages.select("page_id", F.length("html").alias("n")).collect()}
    assert {r.page_id: r.n_chars for r in out.collect()} == want


def test_atom_and_rss_feeds(spark):
    from sitesift.operators.extract_xml import extract_rss
    bodies = [
        (1, "https://f/atom", "<feed><entry><title>3 First</title><id>a</id></entry>"
                              "<entry><title>Second</title></entry></feed>"),
        (2, "https://f/rss", "<rss><channel><entry><title>Only</title><id>b</id></entry></channel></rss>"),
        (3, "https://f/bad", "<rss><channel><entry><title>Broken &amp; kept</title><id>c</id></entry>"),
    ]
    pages = spark.createDataFrame(bodies, "page_id long, url string, html string").withColumn("domain", F.lit("f"))
    cfg = load_site_schema({"f": {"strategy": "rss", "container": "entry", "fields": {"title": "title", "id": "id"}}})[0]
    got = sorted(tuple(r) for r in extract_rss(pages, cfg).select("page_id", "ordinal", "title", "id").collect())
    assert got == [(1, 0, "First", "a"), (1, 1, "Second", "N/A"), (2, 0, "Only", "b"), (3, 0, "Broken & kept", "c")]


def test_stream_dedup_counts_late_rows(spark, tmp_out):
    import pandas as pd
    from sitesift.streaming.ingest import rows_dropped_by_watermark
    src = os.path.join(tmp_out, "ev")
    os.makedirs(src)
    ts = pd.to_datetime
    def put(name, ks, times):
        pd.DataFrame({"k": ks, "ts": [ts(t) for t in times]}).to_parquet(
            os.path.join(src, name), coerce_timestamps="us", allow_truncated_timestamps=True)
    put("a.parquet", [1, 2], ["2024-01-01 10:00", "2024-01-01 10:05"])
    put("b.parquet", [3, 1], ["2024-01-01 12:00", "2024-01-01 12:01"])
    put("c.parquet", [4], ["2024-01-01 09:00"])      # behind the watermark: late
    put("d.parquet", [1], ["2024-01-01 12:30"])      # key 1's state has expired
    ev = (spark.readStream.schema("k long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(src))
    q = (dedup_stream(ev, ["k"], "ts", "30 minutes").writeStream.format("memory").queryName("late_test")
         .option("checkpointLocation", os.path.join(tmp_out, "ck4")).trigger(availableNow=True).start())
    q.awaitTermination()
    keys = sorted(r.k for r in spark.sql("SELECT k FROM late_test").collect())
    # batch 2 drops key 1 (still in state); after it the watermark (11:31)
    # passes key 1's expiry, so batch 4 lets key 1 through again
    assert keys == [1, 1, 2, 3]
    assert rows_dropped_by_watermark(q) == 1


def test_raw_layer_directory_layout(spark, tmp_out):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(3)
    fetched = F.expr("timestampadd(HOUR, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    path = os.path.join(tmp_out, "raw2")
    raw.write_raw(raw.landed_to_raw(pages, fetched), path)
    top = sorted(d for d in os.listdir(path) if not d.startswith(("_", ".")))
    assert top == ["format=html"]
    hosts = os.listdir(os.path.join(path, "format=html"))
    assert hosts and all(h.startswith("netloc=") for h in hosts)
    days = os.listdir(os.path.join(path, "format=html", hosts[0]))
    assert days and all(d.startswith("fetch_date=2024-01-01") for d in days)


def test_stream_to_master_reads_a_table_that_is_a_folder(spark, tmp_out):
    from sitesift import load_site_schema
    from sitesift.streaming.ingest import run_to_master
    rows = [(k, f"http://www.example.com/{k}", f"<body><h1>t{k}</h1></body>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.filter("page_id < 4").repartition(2).write.parquet(f"{tmp_out}/sf/pages.parquet")
    pages.filter("page_id >= 4").coalesce(1).write.parquet(f"{tmp_out}/one")
    one = next(f for f in os.listdir(f"{tmp_out}/one") if f.endswith(".parquet"))
    shutil.copy(f"{tmp_out}/one/{one}", f"{tmp_out}/sf/pages-2.parquet")
    sites = load_site_schema({"example": {"strategy": "detail", "container": "body", "fields": {"title": "h1"}}})
    master = run_to_master(spark, f"{tmp_out}/sf", f"{tmp_out}/master", f"{tmp_out}/ckpt", sites, ["source_url", "ordinal"])
    assert sorted(r.title for r in master.collect()) == [f"t{k}" for k in range(6)]
