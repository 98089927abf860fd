"""Importance resampling towards a target corpus.

Two generative models over hashed word and word-pair counts: one of the target
text (documents labelled good), one of the raw text (all documents). A
document's log weight is the sum over its n-grams of the log ratio of their
bucket probabilities; adding Gumbel noise and taking the k largest draws k
documents without replacement in proportion to their weights (Gumbel top-k).

The raw model counts every document. The target model uses a bounded sample
of labelled ids (``TARGET_DOCS``, those with the smallest hash). Each task
sends its bucket counts once; ``BUCKETS`` rows of sums come back and are the
only broadcast. The k-th largest key is found exactly by narrowing counts over
bins, so no sort of all rows meets in one place.

Defined cases: a null or empty text has no n-gram and log weight 0. The noise
is a function of (doc_id, text, seed): the draw repeats exactly, and rows
repeated with id and text share it. Rows tied with the k-th are all kept.
A null doc_id never counts as target. Without target labels both models are
equal only in their prior: weights then favour rare n-grams alike for all.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._runtime import written

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
TARGET_DOCS = 20_000
SMOOTHING = 1.0
#: Share of the documents drawn.
KEEP = 0.8
SEED = 17
#: The k-th key is read off directly once this few rows are left.
DIRECT = 10_000


def features(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every word and word pair."""
    words, doc = s.words(lower=True)
    pairs, at = T.grams(words, doc, 2)
    key = np.concatenate([T.mix(words), pairs]) >> np.uint64(64 - BUCKET_BITS)
    return key.astype(np.int64), np.concatenate([doc, doc[at]])


def target_ids(labels: DataFrame) -> np.ndarray:
    rows = (labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS).collect())
    return np.sort(np.array([r["doc_id"] for r in rows], np.int64))


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Per bucket: log target probability minus log raw probability."""
    sent = docs.sparkSession.sparkContext.broadcast(target_ids(labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = np.array(batch.column("doc_id").fill_null(-(1 << 63)))
            chosen = np.isin(ids, sent.value)
            for s in T.slices(batch.column("text")):
                key, doc = features(s)
                raw += np.bincount(key, minlength=BUCKETS)
                target += np.bincount(key[chosen[s.first + doc]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         names=["bucket", "raw", "target"])

    sums = (docs.select("doc_id", "text").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())  # <= BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    for r in sums:
        counts[:, r["bucket"]] = r["target"], r["raw"]
    counts += SMOOTHING
    p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return p[0] - p[1]


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text")):
                key, doc = features(s)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(s.first, s.n), batch.column("th").slice(s.first, s.n),
                    pa.array(np.bincount(doc, minlength=s.n).astype(np.int64)),
                    pa.array(np.bincount(doc, sent.value[key], minlength=s.n).astype(np.float64)),
                ], names=["doc_id", "th", "n_grams", "log_weight"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        score, "doc_id bigint, th bigint, n_grams bigint, log_weight double")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "th", F.lit(SEED)), 12)
    uniform = (draw + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("gumbel_key"))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column, exactly."""
    bins = 1024
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = (inside.groupBy(place.alias("b"))
                 .agg(F.count(F.lit(1)).alias("c"), F.min(column).alias("low"), F.max(column).alias("high")).collect())
        for r in sorted(found, key=lambda r: -r["b"]):      # at most ``bins`` rows
            if k <= r["c"]:
                break
            k -= r["c"]
        low, high = r["low"], r["high"]
        if low == high:
            return low
        if r["c"] <= DIRECT:
            some = rows.filter((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()
            return sorted((x[0] for x in some), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Every row with its log weight, its key and whether it is drawn."""
    rows = written(weighted(docs, log_ratios(docs, labels)), "resample")
    k = math.ceil(keep * rows.count())
    if k == 0:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_largest(rows, "gumbel_key", k)))
