"""R2 by event time and the crawl loop over pages in any order."""

import os
import random

from pyspark.sql import functions as F

from sitesift.constants import MAX_EMPTY
from sitesift.streaming import stateful as S
from sitesift.streaming.ingest import rows_dropped_by_watermark


def stream_of(spark, folder, batches, schema):
    """A stream that reads one of ``batches`` at a time, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def run(stream, folder):
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q, stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def first(spark, folder, batches, **more):
    raw = stream_of(spark, os.path.join(folder, "in"), batches, "k string, at string, id long")
    events = raw.select("k", F.to_timestamp("at").alias("t"), "id")
    q, rows = run(S.first_by_time(events, ["k"], "t", "id", "30 minutes", **more), folder)
    return q, sorted((r.k, r.t.strftime("%H:%M"), r.id) for r in rows)


def test_the_smallest_time_wins_in_any_order(spark, tmp_out):
    rows = [("a", at(50), 1), ("b", at(45), 2), ("a", at(40), 3), ("a", at(40), 4), ("b", at(44), 5), ("c", at(60), 6), ("z", at(200), 7)]
    random.Random(1).shuffle(rows)
    _, got = first(spark, tmp_out, [rows[:2], rows[2:4], rows[4:]] if ("z", at(200), 7) in rows[4:] else [rows])
    assert got == [("a", "00:40", 3), ("b", "00:44", 5), ("c", "01:00", 6)]         # z may still have an earlier row


def test_late_rows_are_dropped_and_counted(spark, tmp_out):
    # Spark holds rows late by the watermark of the batch before.
    batches = [[("a", at(100), 1)], [("b", at(300), 2)], [("d", at(301), 8)], [("a", at(90), 3), ("c", at(10), 4), ("b", at(290), 5)], [("z", at(600), 6)]]
    q, got = first(spark, tmp_out, batches)
    assert got == [("a", "01:40", 1), ("b", "04:50", 5), ("d", "05:01", 8)]
    assert rows_dropped_by_watermark(q) == 2


def test_a_key_passes_again_once_its_state_has_expired(spark, tmp_out):
    batches = [[("a", at(10), 1)], [("b", at(100), 2)], [("a", at(101), 3)], [("c", at(400), 4)], [("a", at(401), 5)], [("z", at(900), 6)]]
    _, got = first(spark, os.path.join(tmp_out, "x"), batches, keep_ms=3 * 3_600_000)
    assert got == [("a", "00:10", 1), ("a", "06:41", 5), ("b", "01:40", 2), ("c", "06:40", 4)]
    _, got = first(spark, os.path.join(tmp_out, "y"), batches)
    assert got == [("a", "00:10", 1), ("b", "01:40", 2), ("c", "06:40", 4)]


def crawl(pages, limit):
    """The plain loop over {page: records}, dense from page 1."""
    out, empty, page = [], 0, 1
    while page in pages and empty < MAX_EMPTY and len(out) < limit:
        ids = sorted(pages[page])
        out += [(page, r) for r in ids][:limit - len(out)]
        empty = 0 if ids else empty + 1
        page += 1
    return out


def halted(spark, folder, batches, limit, **more):
    raw = stream_of(spark, os.path.join(folder, "in"), batches, "site string, page int, records array<long>, at string")
    pages = raw.select("site", "page", "records", F.to_timestamp("at").alias("fetched_at"))
    return sorted((r.site, r.page, r.record) for r in run(S.halt_crawl(pages, limit, **more), folder)[1])


def test_crawl_equals_the_loop_over_shuffled_pages(spark, tmp_out):
    rng = random.Random(7)
    sites = {f"s{k}": {p: [100 * p + i for i in range(rng.choice([0, 0, 0, 1, 3]))] for p in range(1, rng.randint(3, 30))} for k in range(12)}
    rows = [(s, p, ids or None, at(p)) for s, pages in sites.items() for p, ids in pages.items()]
    rows += rng.sample(rows, 20) + [("s1", 0, [5], at(0)), ("s2", -3, [6], at(0))]         # twice, and before the first page
    rng.shuffle(rows)
    got = halted(spark, tmp_out, [rows[k::4] for k in range(4)], 9, delay="2 days")
    assert got == sorted((s, *x) for s, pages in sites.items() for x in crawl(pages, 9))


def test_a_missing_page_counts_as_empty_once_the_watermark_has_passed(spark, tmp_out):
    rows = [("a", 1, [1], at(1)), ("a", 3, [3], at(3)), ("b", 7, [7], at(4)), ("c", 6, [6], at(5)), ("d", 2, [2], at(890))]
    more = [("z", 1, [9], at(900))]
    got = halted(spark, tmp_out, [rows, more, [("a", 4, [4], at(899))]], 9, delay="30 minutes")
    # b lacks six pages in a row: halted; c lacks five: halted before its sixth page; d's gap is not yet settled.
    assert got == [("a", 1, 1), ("a", 3, 3), ("a", 4, 4), ("z", 1, 9)]


def test_python_is_called_per_bucket_and_null_keys_are_keys(spark, tmp_out):
    rows = [(k, at(60 - k), 100 + k) for k in range(40)] + [(None, at(30), 1), (None, at(20), 2), (7, at(50), 3), (99, at(400), 4)]
    raw = stream_of(spark, os.path.join(tmp_out, "in"), [rows[:20], rows[20:]], "k long, at string, id long")
    events = raw.select("k", F.to_timestamp("at").alias("t"), "id")
    _, got = run(S.first_by_time(events, ["k"], "t", "id", "2 hours", buckets=2), tmp_out)
    want = {(k, 100 + k) for k in range(40) if k != 7} | {(7, 3), (None, 2)}
    assert {(r.k, r.id) for r in got} == want and len(got) == len(want)
