"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores by its hashed features (each word, and the first 4, 5 and 6 bytes of longer words,
so inflected forms share weight), 0 without any evidence; the document's
score is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels are known, so the gradient
of the bag likelihood is passed to the sentences by their share of it.

Fitting uses a bounded sample of the labelled training rows: ``PER_CLASS``
texts of each label, distinct by id and text, those with the smallest hash of
their id. Their features (not texts) meet in one task; the weights (``BUCKETS`` floats, 1 MB)
are the only thing sent to every worker. Scoring is one pass over the texts.

Defined cases: a null or empty text, or one without words, has no sentence
and scores 0. Labels with a null id or label are ignored; of several labels
of one id the largest holds. Without labelled rows of both kinds every
score is 0. Repeated rows each give a row; a
null doc_id is scored alike (never in the training fold, never held out).
Other columns are never read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

PER_CLASS = 4000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PREFIXES = (4, 5, 6)
BIAS = -6.0
#: A feature needs this many sampled documents to get a weight.
MIN_DOCS = 3
EPOCHS, RATE, SHRINK, DROP, CLEAR = 400, 0.3, 5e-5, 0.25, 1.0
THRESHOLD = 0.7

WORD_SEP = np.zeros(256, bool)
WORD_SEP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


class Bags:
    """Sentences and features of a slice: ``feature`` and its ``sentence``
    (sorted), and the text index ``doc`` and first and last byte of each
    sentence's words."""

    def __init__(self, s: T.Slice):
        begin, end, doc = s.spans(WORD_SEP)
        stops = np.cumsum(_STOP[s.data])[begin] if len(begin) else begin
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (stops[1:] != stops[:-1])]) if len(begin) else np.zeros(0, bool)
        of = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.doc = doc[first]
        self.start = begin[first]
        self.stop = end[np.concatenate([first[1:], [len(begin)]]) - 1] if len(first) else begin
        shift = np.uint64(64 - BUCKET_BITS)
        parts, owners = [s.hashes(begin, end, True) >> shift], [of]
        for k in PREFIXES:
            longer = (end - begin) > k
            b = begin[longer]
            parts.append(T.mix(s.hashes(b, b + k, True) + np.uint64(k)) >> shift)
            owners.append(of[longer])
        key = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BUCKET_BITS)) | np.concatenate(parts))
        self.sentence = (key >> np.uint64(BUCKET_BITS)).astype(np.int64)
        self.feature = (key & np.uint64(BUCKETS - 1)).astype(np.int64)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence, weights[self.feature], minlength=len(self.doc)) + BIAS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to each text's features and the sentence of each."""
    for batch in batches:
        labels = batch.column("label")
        for s in T.slices(batch.column("text")):
            bags = Bags(s)
            owner = bags.doc[bags.sentence]
            cut = np.searchsorted(owner, np.arange(s.n + 1))
            base = np.searchsorted(bags.doc, np.arange(s.n + 1))
            rows = [(bags.feature[a:b].astype(np.int32).tobytes(), (bags.sentence[a:b] - base[i]).astype(np.int32).tobytes(),
                     int(base[i + 1] - base[i])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
            yield pa.RecordBatch.from_arrays([
                labels.slice(s.first, s.n), pa.array([r[0] for r in rows], pa.binary()),
                pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()),
            ], names=["label", "features", "sentences", "n_sentences"])


def hazard(z: np.ndarray) -> np.ndarray:
    """-log(1 - p) of each sentence, measured from a sentence without any
    evidence: that one adds nothing, however many a text has of them."""
    return np.maximum(np.logaddexp(0, z) - np.logaddexp(0, BIAS), 0)


def train(feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights (none below 0) by Adagrad on the noisy-or likelihood with an
    L1 penalty. ``sentence`` indexes sentences, ``doc`` the text of each."""
    weights = np.zeros(BUCKETS, np.float32)
    if not len(feature):
        return weights
    used = np.flatnonzero(np.bincount(feature, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    local = place[feature]
    w, history, rng = np.zeros(len(used)), None, np.random.Generator(np.random.PCG64(6))
    positive = label[doc] > 0
    per_class = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label <= 0).sum()))[doc]
    for epoch in range(EPOCHS):
        # Second half: only the clear features, and some of them left out each
        # time, so that one alone learns to convict.
        late = epoch >= EPOCHS // 2
        seen = np.flatnonzero(rng.random(len(local), np.float32) >= DROP) if late else slice(None)
        at, of = local[seen], sentence[seen]
        z = np.bincount(of, w[at], minlength=len(doc)) + BIAS
        slope = 1 / (1 + np.exp(-z))
        total = np.bincount(doc, hazard(z), minlength=len(label))[doc]      # -log(1 - P) of the text
        share = np.where(positive, -1 / np.expm1(np.maximum(total, 1e-2)), 1.0)
        g = np.bincount(at, (slope * share * (1 / len(label) if late else per_class))[of], minlength=len(used)) + SHRINK
        if history is None:     # features with little evidence in all take small steps
            history = np.full(len(used), (0.02 * np.abs(g).max()) ** 2 + 1e-16)
        history += g * g
        w = np.maximum(w - RATE / np.sqrt(history) * g, 0)
        if epoch % 20 == 19:    # a weight at 0 that the data push down stays there
            live = w >= CLEAR if epoch == EPOCHS // 2 - 1 else (w > 0) | (g < 0)
            keep = live[local]
            sentence, local = sentence[keep], (np.cumsum(live) - 1)[local[keep]]
            used, w, history = used[live], w[live], history[live]
    weights[used] = w
    return weights


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, sentences, sizes, label = [], [], [], []
    spread = np.zeros(BUCKETS, np.int32)        # documents that have a feature
    for batch in batches:
        for y, f, s, n in zip(*(batch.column(c).to_pylist() for c in ("label", "features", "sentences", "n_sentences"))):
            features.append(np.frombuffer(f, np.int32))
            sentences.append(np.frombuffer(s, np.int32))
            spread[np.unique(features[-1])] += 1
            sizes.append(n)
            label.append(y)
    weights = np.zeros(BUCKETS, np.float32)
    if 0 < sum(label) < len(label):
        first = np.cumsum(sizes) - sizes
        for i, f in enumerate(features):        # rare features go before anything is put together
            keep = spread[f] >= MIN_DOCS
            features[i], sentences[i] = f[keep], (sentences[i][keep] + first[i]).astype(np.int32)
        weights = train(np.concatenate(features), np.concatenate(sentences),
                        np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(label))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def chosen_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(text, label) of the documents that ``sample(doc_id, label)`` names. An
    id that several rows carry gives one row of each text, in all at most
    ``PER_CLASS`` of a label."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Copies go by hash, partly before the exchange, so that no text is grouped by.
    keys = rows.groupBy("label", "doc_id", F.xxhash64("text").alias("h"), size.alias("n")).agg(F.lit(1).alias("one"))
    kept = None
    for y in (0, 1):
        part = keys.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "h", "n").limit(PER_CLASS)
        kept = part if kept is None else kept.union(part)
    marked = (rows.withColumn("h", F.xxhash64("text")).withColumn("n", size)
              .join(F.broadcast(kept.select("label", "doc_id", "h", "n")), ["label", "doc_id", "h", "n"]))
    # Of the copies of a text each task passes on one, then one is left.
    return marked.groupBy("label", "doc_id", "h", "n").agg(F.max("text").alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weights, learned from labelled rows outside fold 1."""
    known = (labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 1)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        sample = part if sample is None else sample.union(part)
    chosen = chosen_texts(docs, sample)
    bags = chosen.mapInArrow(_features, "label int, features binary, sentences binary, n_sentences int")
    rows = bags.repartition(1).mapInArrow(_fit_task, "weights binary").collect()   # one row of 1 MB
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else np.zeros(BUCKETS, np.float32)


SCORED = "score double, n_sentences bigint, worst_sentence bigint, worst_score double"


def _score_slice(s: T.Slice, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    bags = Bags(s)
    z = bags.logits(weights)
    score = -np.expm1(-np.bincount(bags.doc, hazard(z), minlength=s.n))
    count = np.bincount(bags.doc, minlength=s.n)
    first = np.searchsorted(bags.doc, np.arange(s.n))
    best = np.full(s.n, -np.inf)
    np.maximum.at(best, bags.doc, z)
    hit = np.flatnonzero(z == best[bags.doc])
    worst = np.zeros(s.n, np.int64)
    worst[bags.doc[hit[::-1]]] = hit[::-1] - first[bags.doc[hit[::-1]]]
    return score, count, worst, -np.expm1(-hazard(best))


def scorer(spark, weights: np.ndarray):
    """Arrow function of a text column: struct of SCORED."""
    from pyspark.sql.functions import arrow_udf
    sent = spark.sparkContext.broadcast(weights)

    @arrow_udf(f"struct<{SCORED.replace(' ', ':')}>".replace(",:", ","))
    def scored(text: pa.Array) -> pa.Array:
        parts = [_score_slice(s, sent.value) for s in T.slices(text)]
        score, count, worst, most = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4))
        none = count == 0
        return pa.StructArray.from_arrays([
            pa.array(score, pa.float64()), pa.array(count.astype(np.int64)),
            pa.array(worst.astype(np.int64), mask=none), pa.array(most, pa.float64(), mask=none),
        ], names=["score", "n_sentences", "worst_sentence", "worst_score"])
    return scored


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of each."""
    scored = scorer(docs.sparkSession, fit(docs, labels))
    rows = docs.select("doc_id", scored(F.col("text")).alias("s"))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "s.score",
                       (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"),
                       "s.n_sentences", "s.worst_sentence", "s.worst_score")


def mild_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they came."""
    scored = scorer(docs.sparkSession, fit(docs, labels))
    row = docs.select(F.struct("*").alias("_row"), scored(F.col("text")).alias("_s"))
    return row.filter(F.col("_s.score") < THRESHOLD).select("_row.*")


def offending(docs: DataFrame, weights: np.ndarray, at_least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, score, text) of every sentence that scores
    ``at_least``: where a document's toxicity comes from."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for s in T.slices(batch.column("text")):
                bags = Bags(s)
                p = -np.expm1(-hazard(bags.logits(sent.value)))
                hit = np.flatnonzero(p >= at_least)
                base = np.searchsorted(bags.doc, np.arange(s.n))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(s.first + bags.doc[hit], pa.int64())), pa.array(hit - base[bags.doc[hit]], pa.int64()),
                    pa.array(p[hit]), pa.array([s.data[bags.start[i]:bags.stop[i]].tobytes().decode() for i in hit], pa.string()),
                ], names=["doc_id", "sentence", "score", "text"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id bigint, sentence bigint, score double, text string")
