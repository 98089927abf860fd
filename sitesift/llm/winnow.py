"""Benchmark decontamination by winnowing, in DataFrame operations only.

Fingerprints: the hash of every K-word run; of the runs inside a window of
``SPAN`` words only the smallest counts (a window of ``SPAN - K + 1`` hashes).
Two texts that share ``SPAN`` consecutive words hold that window in common and
so its smallest hash: joining on it misses no shared span of that length. Each
match is then extended: the window's whole word sequence must be equal, and a
shared passage is found window by window over its full length. An item of
fewer than SPAN words is one window of its own length, fingerprinted alike.

The benchmark's windows are a broadcast side only up to ``BLOCK`` rows (about
100 MB at most); a larger benchmark is dealt window by window into such blocks,
so that a very frequent fingerprint is dealt too, and the documents are read
once for each. Every document carries an end mark
through the same pass, so its word count needs no second read. Only hits are
shuffled: a passage that many documents share gives each of them its own rows.

Defined cases: a null or empty text, or one without words, has no hits and is
clean; a null or wordless item has no window; a null item_id reads as ''.
Repeated rows each give a row. Hits are kept per (doc_id, text), so two texts
under one doc_id stay apart. Other columns are ignored. Empty tables: an empty
benchmark leaves every document clean, no documents give no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import written
from ._words import END_MARK, hashed, same_rows, word_hashes

SPAN, K = 13, 5
BLOCK = 400_000
#: A document is contaminated from hit words >= 1 / SHARE of its words.
SHARE = 20


def _run_hashes(h: Column, k: int) -> Column:
    """Hash of the k words from each place (null past the end)."""
    return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))


def _smallest(runs: Column, at: Column, span: int, k: int) -> Column:
    hashes = [F.get(runs, at + j) for j in range(span - k + 1)]
    return F.least(*hashes) if len(hashes) > 1 else hashes[0]


def _runs(df: DataFrame, spans: list[int]) -> DataFrame:
    """Adds ``r<k>`` for every run length that ``spans`` need, in one
    projection of its own (it is read many times)."""
    return df.withColumns({f"r{k}": _run_hashes(F.col("h"), k) for k in sorted({min(K, s) for s in spans})})


def windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, span, fingerprint ``m``, word hashes ``win``)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             word_hashes(F.col("text")).alias("h")).filter("size(h) > 0")
    items = items.withColumn("span", F.least(F.size("h"), F.lit(SPAN)))
    items = items.select("item_id", "span", "h", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("span"))).alias("i"))
    cut = items.select("item_id", "span", F.slice("h", F.col("i") + 1, F.col("span")).alias("win"))
    found = None
    for span in range(SPAN, 0, -1):
        part = _runs(cut.filter(F.col("span") == span).withColumnRenamed("win", "h"), [span])
        part = part.select("item_id", "span", _smallest(F.col(f"r{min(K, span)}"), F.lit(0), span, min(K, span)).alias("m"),
                           F.col("h").alias("win"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _hits(docs: DataFrame, known: DataFrame, spans: list[int], with_marks: bool) -> DataFrame:
    """(doc_id, th, n_words, at, span, wid) per hit window, and a row with
    span 0 per document where ``with_marks``."""
    runs = _runs(hashed(docs), spans)
    marked = F.array_append("h", F.lit(END_MARK))
    places = runs.select("*", F.size("h").alias("n_words"), F.posexplode(marked).alias("at", "x"))
    each = []
    for span in spans:
        k = min(K, span)
        small = _smallest(F.col(f"r{k}"), F.col("at"), span, k)
        each.append(F.struct(F.when(F.col("at") <= F.col("n_words") - span, small).alias("m"), F.lit(span).alias("span")))
    if with_marks:
        each.append(F.struct(F.when(F.col("at") == F.col("n_words"), F.lit(END_MARK)).alias("m"), F.lit(0).alias("span")))
    if len(each) == 2 and with_marks:   # the common case: one span, no second explode
        first, mark = each
        places = places.withColumn("p", F.when(F.col("at") == F.col("n_words"), mark).otherwise(first))
    else:
        places = places.withColumn("p", F.explode(F.array(*each)))
    keyed = places.select("doc_id", "th", "n_words", "h", "at", F.col("p.m").alias("m"), F.col("p.span").alias("span"))
    near = keyed.join(F.broadcast(known.withColumnRenamed("span", "s2")), "m")
    same = (F.col("span") == F.col("s2")) & (F.slice("h", F.col("at") + 1, F.col("span")) == F.col("win"))
    return near.filter(same).select("doc_id", "th", "n_words", "at", "span", "wid")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    of_item = written(windows(benchmark).withColumn("wid", F.xxhash64("win")), "winnow-items")
    distinct = of_item.select("m", "span", "win", "wid").distinct()
    spans = sorted((r["span"] for r in of_item.select("span").distinct().collect()), reverse=True) or [SPAN]
    n_blocks = max(1, -(-distinct.count() // BLOCK))
    mark = spark.range(1).select(F.lit(END_MARK).cast("bigint").alias("m"), F.lit(0).alias("span"),
                                 F.array().cast("array<bigint>").alias("win"), F.lit(None).cast("bigint").alias("wid"))
    parts = []
    for b in range(n_blocks):
        block = distinct if n_blocks == 1 else distinct.filter(F.pmod("wid", F.lit(n_blocks)) == b)
        block = block.select("m", "span", "win", "wid")
        parts.append(_hits(docs, block.union(mark) if b == 0 else block, spans, b == 0))
    hits = written(functools.reduce(DataFrame.union, parts), "winnow-hits")

    # Words inside the union of the hit windows, in order of their start.
    place = F.when(F.col("span") > 0, F.struct("at", (F.col("at") + F.col("span")).alias("to")))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(acc["to"], x["at"]))).alias("n"),
        F.greatest(acc["to"], x["to"]).alias("to"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    rows = hits.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.count_if(F.col("span") == 0).alias("copies"),
        F.aggregate(F.array_sort(F.collect_set(place)), start, step, lambda acc: acc["n"]).cast("bigint").alias("n_hit"))
    items = (hits.filter("span > 0").select("doc_id", "th", "wid").distinct()
             .join(of_item.select("wid", "item_id").distinct(), "wid")
             .select("doc_id", "th", "item_id").distinct().groupBy("doc_id", "th")
             .agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    both = rows.join(items.withColumnsRenamed({"doc_id": "d2", "th": "t2"}),
                     F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    out = both.select(
        "doc_id", "th", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they came."""
    bad = decontaminate(docs, benchmark).filter("contaminated").select("doc_id", "th").distinct()
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.xxhash64("text").alias("th"))
    return row.join(bad, same_rows(row, bad), "left_anti").select("_row.*")
