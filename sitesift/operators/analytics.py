"""The market brief as Spark aggregations.

Every metric is a hash aggregate with map-side partial aggregation, usually in
two stages (per value, then per group), so a dominant domain, entity or word
is pre-reduced in each map task before anything is shuffled. Top-k per group
uses ``row_number() <= k``, which Spark plans with a partial
``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..constants import MONEY_COLUMNS, PENDING, TEXT_COLUMNS  # fixed values
from ..functions.text import NA, keep_word, words
from .joins import join_small, materialize, numbered, stored

#: The words are split into about so many blocks, fewer where a block would have less ids, more where it would have more.
WORD_GROUPS = 7
IDS_AT_LEAST = 50_000
IDS_PER_GROUP = 10_000_000
#: Ids of records that are stored together; pairs that are counted at once; pairs that a task returns at once.
STRETCH_IDS = 1_000_000
PAIRS_AT_ONCE = 4_000_000
ROWS_AT_ONCE = 200_000
#: Words whose components a task holds.
WORDS_AT_ONCE = 1_000_000
#: A vocabulary of so many words (a row is under 100 bytes) is broadcast.
VOCABULARY_ROWS = 1_000_000


PLACEHOLDERS = ("", NA, PENDING)


def record_count(df: DataFrame, group_cols: list[str] = ()) -> DataFrame:
    """A1."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_records"))


def quantiles(df: DataFrame, value_col: str, group_cols: list[str], qs: list[float]) -> DataFrame:
    """Exact quantiles per group (linear interpolation), one column ``q<i>``
    each, without a per-group state: counts per distinct value, laid out by
    range over (group, value), summed up inside each partition and over the
    partitions; the two ranks around a quantile are then plain filters. A
    group with a third of all rows is spread over as many partitions as its
    distinct values need."""
    g, v = list(group_cols), F.col(value_col)
    counts = df.filter(v.isNotNull()).groupBy(*g, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    laid = materialize(counts.repartitionByRange(*[F.col(c) for c in g], F.col("_v")).withColumn("_p", F.spark_partition_id()))
    per = laid.groupBy(*g, "_p").agg(F.sum("_c").alias("_s"))     # a row per partition that a group touches
    before = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*g, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"),
                      F.sum("_s").over(Window.partitionBy(*g)).alias("_n"))
    same = F.col("_p") == F.col("_p2")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    placed = laid.join(base.withColumnsRenamed({"_p": "_p2"} | {c: f"_g_{c}" for c in g}), same).drop("_p2", *[f"_g_{c}" for c in g])
    upto = Window.partitionBy(*g, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_to", F.col("_b") + F.sum("_c").over(upto))      # ranks [_to - _c, _to)
    aggs = []
    for i, q in enumerate(qs):
        at = (F.col("_n") - 1) * F.lit(q)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")), F.col("_v"))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*g).agg(F.max("_n").alias("_n"), *aggs)
    def between(i: int, q: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        return F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)
    return picked.select(*g, *[between(i, q).alias(f"q{i}") for i, q in enumerate(qs)])


def price_stats(df: DataFrame, value_col: str, group_cols: list[str] = (), exact: bool = True,
                accuracy: int = 10000, digits: int | None = 6,
                decimal_scale: int | None = None) -> DataFrame:
    """A2 + A3 + A7: count, valid count, min, max, mean, median, p90, std.

    NULL values are not valid and are ignored; a group with none gives NULL
    statistics. ``exact`` takes the quantiles by rank (:func:`quantiles`,
    linear interpolation as pandas' ``quantile``); ``exact=False`` uses
    ``percentile_approx``.

    ``decimal_scale``: for money with a fixed number of decimals, the mean is
    an exact DECIMAL sum divided once by the count, so it does not depend on
    how the rows were partitioned (a double sum does, in its last bits).
    """
    g, v = list(group_cols), F.col(value_col)
    if decimal_scale is None:
        mean = F.avg(v)
    else:
        total = F.sum(v.cast(f"decimal(38,{decimal_scale})")).cast("double")
        mean = total / F.count(v)
    aggs = [F.count(F.lit(1)).alias("n_records"), F.count(v).alias("n_valid"), F.min(v).alias("min_value"),
            F.max(v).alias("max_value"), mean.alias("mean_value"), F.stddev_samp(v).alias("std_value")]
    if not exact:
        aggs.append(F.percentile_approx(v, F.array(F.lit(0.5), F.lit(0.9)), accuracy).cast("array<double>").alias("_q"))
    out = df.groupBy(*g).agg(*aggs)
    if exact:
        ranks = quantiles(df.select(*g, v) if g else df.select(v), value_col, g, [0.5, 0.9])
        if g:
            ranks = ranks.withColumnsRenamed({c: f"_r_{c}" for c in g})
            same = F.lit(True)
            for c in g:
                same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
            out = out.join(ranks, same, "left")
        else:
            out = out.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one", "left")
        out = out.withColumnsRenamed({"q0": "median_value", "q1": "p90_value"})
    else:
        out = out.withColumn("median_value", F.col("_q")[0]).withColumn("p90_value", F.col("_q")[1])
    cols = g + ["n_records", "n_valid", "min_value", "max_value", "mean_value", "median_value", "p90_value", "std_value"]
    out = out.select(*cols)
    if digits is not None:
        for c in ("min_value", "max_value", "mean_value", "median_value", "p90_value", "std_value"):
            out = out.withColumn(c, F.round(c, digits))
    return out


def text_column(columns: list[str]) -> str | None:
    """A4: which column the keywords come from (driver side, from the schema)."""
    return next((c for c in TEXT_COLUMNS if c in columns), None)


def keyword_counts(df: DataFrame, text_col: str, group_cols: list[str] = ()) -> DataFrame:
    """A4: word counts; ``explode`` and the stop-word filter stay in the map
    stage, the count is partially aggregated before the shuffle."""
    exploded = df.select(*group_cols, F.explode(words(text_col)).alias("word")).filter(keep_word("word"))
    return exploded.groupBy(*group_cols, "word").agg(F.count(F.lit(1)).alias("n"))


def top_keywords(counts: DataFrame, group_cols: list[str] = (), k: int = 5) -> DataFrame:
    """A5: top ``k`` words by count (ties: word ascending), with their rank."""
    w = Window.partitionBy(*group_cols).orderBy(F.col("n").desc(), F.col("word").asc())
    return (counts.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).select(*group_cols, "rank", "word", "n"))


def low_keywords(counts: DataFrame, group_cols: list[str] = (), k: int = 3,
                 min_distinct: int = 3) -> DataFrame:
    """Only for groups with more than ``min_distinct`` words: the last
    ``k`` of the count-ordered list among words seen more than once, or the
    last ``k`` overall when every word is seen once. Rank 1 = the last."""
    g = list(group_cols)
    counts = materialize(counts)  # tokenised once, read by both sides below
    stats = counts.groupBy(*g).agg(F.count(F.lit(1)).alias("_nd"), F.max("n").alias("_maxn"))
    cand = (join_small(counts, stats, g, "inner") if g else
            counts.withColumn("_nd", stats.select("_nd").scalar())
                  .withColumn("_maxn", stats.select("_maxn").scalar()))
    cand = cand.filter((F.col("_nd") > min_distinct) & ((F.col("n") > 1) | (F.col("_maxn") == 1)))
    w = Window.partitionBy(*g).orderBy(F.col("n").asc(), F.col("word").desc())
    return (cand.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).select(*g, "rank", "word", "n"))


def _tails(bounds: list[int]):
    """Per record and word group (ids from ``bounds[g - 1]`` up to
    ``bounds[g]``): the group and the record's ids from its first word of the
    group on, as a function for ``mapInArrow``. :func:`keyword_pairs` deals
    words in blocks instead; kept for other callers and its test."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                ids = batch.column("ids").slice(at, step)
                flat, size = np.asarray(ids.flatten()), np.asarray(pc.list_value_length(ids))
                ends = np.cumsum(size)
                owner = np.repeat(np.arange(len(size)), size)
                group = np.searchsorted(bounds, flat, side="right")
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])]))
                first = first[ends[owner[first]] - first > 1]      # a last word alone has no pair
                length = ends[owner[first]] - first
                offsets = np.concatenate([[0], np.cumsum(length)])
                picked = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(group[first].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[picked])),
                ], names=["g", "ids"])
    return run


def _runs(doc_col: str):
    """Rows of (record, number of the row, word id) to a row per run of one
    row's ids, as a function for ``mapInArrow``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row = np.asarray(batch.column("_row"))
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(doc_col).take(pa.array(first)),
                    pa.ListArray.from_arrays(pa.array(np.append(first, np.int32(len(row)))), batch.column("id")),
                ], names=[doc_col, "ids"])
    return run


def _blocks(bounds: list[int]):
    """Records' ids, sorted by record, to a row per stretch of records and
    block of words (ids from ``bounds[k - 1]`` up to ``bounds[k]``), as a
    function for ``mapInArrow``: how many records, how many ids of the block
    each has, the ids. Rows of one record are united first. What the rows
    counted too often for the records, and all of the record without an id,
    goes to block -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, n_blocks = TaskContext.get().partitionId(), 0, len(bounds) + 1

        def rows(blocks: list[int], data: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array(blocks, pa.int32()), pa.array([(part << 32) + made] * len(blocks), pa.int64()),
                pa.array([x.astype(np.int32).tobytes() for x in data], pa.binary())], names=["blk", "stretch", "data"])

        def dealt(keys: np.ndarray) -> pa.RecordBatch:
            ids = (keys & 0xFFFFFFFF).astype(np.int32)
            owner = np.cumsum(np.concatenate([[0], np.diff(keys >> 32) != 0]))
            block = np.searchsorted(bounds, ids, side="right")
            each = np.bincount(owner * n_blocks + block, minlength=(owner[-1] + 1) * n_blocks).reshape(-1, n_blocks)
            return rows([*range(n_blocks)], [np.concatenate([[len(each)], each[:, k], ids[block == k]]) for k in range(n_blocks)])

        last, held, ready, n_ready, owners = None, np.zeros(0, np.int64), [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, ids = batch.column(0), batch.column("ids")
            code = np.asarray(doc.dictionary_encode(null_encoding="encode").indices)
            change = np.concatenate([[last is None or last != (doc[0].as_py(),)], code[1:] != code[:-1]])
            owner = owners + np.cumsum(change)
            keys = (np.repeat(owner, np.asarray(pc.list_value_length(ids))) << 32) | np.asarray(ids.flatten()).astype(np.int64)
            keys, times = np.unique(np.concatenate([held, keys]), return_counts=True)
            surplus = [np.repeat(keys, times - 1) & 0xFFFFFFFF]
            owners = int(owner[-1])
            whole = int(np.searchsorted(keys, owners << 32))           # the last record may go on in the next batch
            if last == (None,) or doc.null_count:
                none = owners if doc[len(doc) - 1].as_py() is None else int(owner[doc.null_count]) - 1
                if none < owners:
                    surplus.append(keys[(keys >> 32) == none] & 0xFFFFFFFF)
            if any(len(x) for x in surplus):
                yield rows([-1], [np.concatenate(surplus)])
            last, held = (doc[len(doc) - 1].as_py(),), keys[whole:]
            if whole:
                ready.append(keys[:whole])
                n_ready += whole
            if n_ready >= STRETCH_IDS:
                yield dealt(np.concatenate(ready))
                ready, n_ready = [], 0
        if len(held):
            if last == (None,):
                yield rows([-1], [held & 0xFFFFFFFF])
            yield dealt(np.concatenate([*ready, held]))
    return run


def _surplus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data"):
            ids, n = np.unique(np.frombuffer(data.as_buffer(), np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "n"])


def _names(bounds: list[int]):
    """Rows of (id, word, df) as rows of the blocks, beside those of
    :func:`_blocks`, as a function for ``mapInArrow``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, data = np.searchsorted(bounds, np.asarray(batch.column("id")), side="right"), []
            for k in (kinds := np.unique(block)):
                with pa.ipc.new_stream(out := pa.BufferOutputStream(), batch.schema) as stream:
                    stream.write_batch(batch.take(pa.array(np.flatnonzero(block == k))))
                data.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([-1] * len(kinds), pa.int64()),
                                              pa.array(data, pa.binary())], names=["blk", "stretch", "data"])
    return run


def _count_pairs(i: int, j: int, edges: list[int], n_docs: int, min_support: int):
    """All pairs of a word of block ``i`` with a more frequent one of block
    ``j`` (block ``k``: ids from ``edges[k]`` up to ``edges[k + 1]``), by name,
    with their support and lift, as a function for ``mapInArrow`` over the
    rows of both blocks."""
    base, width = edges[j], edges[j + 1] - edges[j]

    def read(rows: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        got = [rows[k] for k in sorted(rows)]
        return np.concatenate([x[1:x[0] + 1] for x in got]), np.concatenate([x[x[0] + 1:] for x in got])

    min_support = max(1, min_support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, np.ndarray]] = {i: {}, j: {}}
        names: list[pa.Table] = []
        for batch in batches:
            for block, stretch, data in zip(batch.column("blk").to_pylist(), batch.column("stretch").to_pylist(), batch.column("data")):
                if stretch < 0:
                    names.append(pa.ipc.open_stream(data.as_buffer()).read_all())
                else:
                    found[block][stretch] = np.frombuffer(data.as_buffer(), np.int32)
        if not found[i] or not names:
            return
        named = pa.concat_tables(names).combine_chunks()
        word_id, spelt, df = (named.column(c).combine_chunks() for c in ("id", "word", "df"))
        word_id, df = np.asarray(word_id), np.asarray(df)
        by_name = np.empty(len(df), np.int64)
        by_name[np.asarray(pc.sort_indices(spelt))] = np.arange(len(df))
        place_i, place_j = (np.full(edges[k + 1] - edges[k], -1, np.int32) for k in (i, j))
        for k, place in ((i, place_i), (j, place_j)):
            mine = np.flatnonzero((word_id >= edges[k]) & (word_id < edges[k + 1]))
            place[word_id[mine] - edges[k]] = mine
        size, flat = read(found[i])
        own, (met_size, met_flat) = flat, ((size, flat) if i == j else read(found[j]))
        found.clear()
        met_flat = met_flat - np.int32(base)
        stop = np.cumsum(met_size).astype(np.int32)
        to = np.repeat(stop, size)
        start = np.arange(1, len(own) + 1, dtype=np.int32) if i == j else np.repeat((stop - met_size).astype(np.int32), size)
        paired = np.flatnonzero(start < to)
        order = paired[np.argsort(own[paired])]
        own, start, to = own[order], start[order], to[order]
        del paired, order, size, flat
        word, records = np.unique(own, return_counts=True)
        kept = np.repeat(records >= min_support, records)          # else no pair can have the support
        start, to, word, records = start[kept], to[kept], word[records >= min_support], records[records >= min_support]
        if not len(word):
            return
        first = np.cumsum(records) - records
        pairs = np.add.reduceat((to - start).astype(np.int64), first)

        def met_by(k: int, n: int) -> np.ndarray:                  # what the records from k on have of the other block
            return np.concatenate([met_flat[x:y] for x, y in zip(start[k:k + n].tolist(), to[k:k + n].tolist())])

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            sparse, light = pairs * 8 < width, pairs < PAIRS_AT_ONCE // 16
            for few, by_sorting in ((np.flatnonzero(sparse & light), True), (np.flatnonzero(~sparse & light), False)):
                cuts = np.flatnonzero(np.diff(np.cumsum(pairs[few]) // (PAIRS_AT_ONCE // 16)) > 0) + 1
                for some in np.split(few, cuts) if len(few) else []:   # many words at once
                    kind = np.int32 if len(some) * width < 1 << 31 else np.int64
                    met = np.concatenate([met_by(k, n) for k, n in zip(first[some].tolist(), records[some].tolist())])
                    met = met + np.repeat(np.arange(len(some), dtype=kind) * kind(width), pairs[some])
                    if by_sorting:
                        met.sort()
                        reach = max(0, len(met) - min_support + 1)
                        at = np.flatnonzero((np.diff(met, prepend=-1) != 0)[:reach] & (met[min_support - 1:] == met[:reach]))
                        at, times = met[at], np.searchsorted(met, met[at], side="right") - at
                    else:
                        times = np.bincount(met)
                        at = np.flatnonzero(times >= min_support)
                        times = times[at]
                    yield word[some[at // width]], at % width, times
            for w in np.flatnonzero(~light).tolist():              # so many records at once that memory stays flat
                times, each = np.zeros(width, np.int64), max(1, PAIRS_AT_ONCE * int(records[w]) // int(pairs[w]))
                for k in range(0, int(records[w]), each):
                    times += np.bincount(met_by(int(first[w]) + k, min(each, int(records[w]) - k)), minlength=width)
                at = np.flatnonzero(times >= min_support)
                yield np.full(len(at), word[w]), at, times[at]

        def table(some: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b, support = (np.concatenate(x) for x in zip(*some))
            both = np.flatnonzero((a >= 0) & (b >= 0))             # words in too few records have no name
            a, b, support = a[both], b[both], support[both].astype(np.int64)
            turned = by_name[a] > by_name[b]
            lift = (support * n_docs).astype(np.float64) / (df[a] * df[b]).astype(np.float64)
            return pa.RecordBatch.from_arrays([spelt.take(pa.array(np.where(turned, b, a))), spelt.take(pa.array(np.where(turned, a, b))),
                                               pa.array(support), pa.array(lift)], names=["word_a", "word_b", "support", "lift"])

        some, rows = [], 0
        for one, met, times in counted():
            some.append((place_i[one - edges[i]], place_j[met], times))
            rows += len(met)
            if rows >= ROWS_AT_ONCE:
                yield table(some)
                some, rows = [], 0
        if some:
            yield table(some)
    return run


def _word_blocks(vocab: DataFrame, n_words: int) -> list[int]:
    """Bounds that split the word numbers into blocks of about equally many
    ids in the table, from sums over at most 4096 stretches of words."""
    step = n_words // 4096 + 1
    sums = vocab.groupBy((F.col("id") / step).cast("int").alias("s")).agg(F.sum("n").alias("n")).orderBy("s").collect()
    total = sum(r["n"] for r in sums)
    blocks = max(min(WORD_GROUPS, total // IDS_AT_LEAST), total // IDS_PER_GROUP) + 1
    bounds, passed = [], 0
    for r in sums:
        if passed * blocks >= total * (len(bounds) + 1):
            bounds.append(r["s"] * step)
        passed += r["n"]
    return bounds


def _rounded(x: Column, digits: int) -> Column:
    """``round(x, digits)``; its decimals only where a half is near or ``x`` is large."""
    scale = 10.0 ** digits
    scaled = x * F.lit(scale)
    clear = (F.abs(x) < 1e6) & (F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-3)
    return F.when(clear, F.rint(scaled) / F.lit(scale)).otherwise(F.round(x, digits))


def keyword_pairs(df: DataFrame, text_col: str, doc_col: str, min_support: int = 5) -> DataFrame:
    """Keyword pairs that stand together in at least ``min_support``
    records (``doc_col`` names a record), with the lift over chance:
    ``support * n_docs / (df_a * df_b)``.

    A pair can only reach that support if both its words do, so the vocabulary
    is every word in at least ``min_support`` records: an absolute bound, not
    a share of the table, and nothing else is left out. Words are numbered by
    rising frequency, counted by rows at first; rows of one record are united
    where its ids meet, and what they counted too often is taken off. The
    words are split into blocks of about equally many ids, and the ids are
    stored once, a folder per block. A task reads two blocks and counts the
    pairs between them, one word at a time, so each id is on disk once (and
    once in the shuffle by record), however many blocks there are, no pair is
    ever shuffled and only pairs with the support leave the task, by name.

    The work grows with the square of a record's distinct words, by the nature
    of the question. A task holds two blocks, ``IDS_PER_GROUP`` ids each; there
    are as many tasks as pairs of blocks, and a block is read once for each
    other. The vocabulary is joined to the words; it is broadcast only where a
    count proves it small.
    """
    found = df.select(doc_col, F.monotonically_increasing_id().alias("_row"), F.array_distinct(words(text_col)).alias("_words"))
    found = found.select(doc_col, "_row", F.explode("_words").alias("word")).filter(keep_word("word"))
    row_freq = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n_docs = df.count()
    vocab = materialize(numbered(row_freq.filter(F.col("n") >= min_support).orderBy("n")).withColumn("id", F.col("id").cast("int")))
    size = vocab.count()
    if size >= 1 << 31:
        raise ValueError(f"{size} words: word numbers have 31 bits")
    small = (lambda x: x) if size > VOCABULARY_ROWS else F.broadcast
    bounds = _word_blocks(vocab, size)
    runs = found.join(small(vocab.select("word", "id")), "word").select(doc_col, "_row", "id").mapInArrow(
        _runs(doc_col), StructType([found.schema[doc_col], StructField("ids", ArrayType(IntegerType()))]))
    ids = stored(runs.repartition(doc_col).sortWithinPartitions(doc_col)
                 .mapInArrow(_blocks(bounds), "blk int, stretch bigint, data binary"), "keyword-ids", ["blk"])
    surplus = ids.filter("blk = -1").mapInArrow(_surplus, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("_less"))
    vocab = materialize(vocab.join(surplus, "id", "left").select("id", "word", (F.col("n") - F.coalesce("_less", F.lit(0))).alias("df"))
                        .filter(F.col("df") >= min_support))
    names = stored(vocab.mapInArrow(_names(bounds), "blk int, stretch bigint, data binary"), "keyword-names", ["blk"])
    rows = ids.select("blk", "stretch", "data").unionAll(names.select("blk", "stretch", "data"))
    edges, kind = [0, *bounds, size], "word_a string, word_b string, support bigint, lift double"
    # the first is empty: of parts with one partition each, the union would be one partition too
    counted = reduce(DataFrame.unionAll, [rows.filter(F.col("blk") < -1).mapInArrow(lambda batches: batches, rows.schema)
                                          .selectExpr("'' AS word_a", "'' AS word_b", "stretch AS support", "0D AS lift")] + [
        rows.filter(F.col("blk").isin(i, j)).coalesce(1).mapInArrow(_count_pairs(i, j, edges, n_docs, min_support), kind)
        for i in range(len(bounds) + 1) for j in range(i, len(bounds) + 1)])
    return counted.withColumn("lift", _rounded(F.col("lift"), 6))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs to a row per word: the word, a word of its component (by the
    linked pairs of this task) and whether that is another. Beyond
    ``WORDS_AT_ONCE`` words, what there is goes out and the rest starts anew."""
    number: dict[str, int] = {}
    end = np.zeros(0, np.int64)

    def stars() -> pa.RecordBatch:
        spelt = pa.array([*number], pa.string())
        return pa.RecordBatch.from_arrays([spelt, spelt.take(pa.array(end)), pa.array(end != np.arange(len(end)))], names=["word_a", "word_b", "linked"])

    def united(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal end
        while True:
            a, b = end[a], end[b]
            apart = a != b
            if not apart.any():
                return
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(end, a, b)                               # the smallest one met; all that hangs on it follows
            while not np.array_equal(up := end[end], end):
                end = up

    def added(some: list[pa.RecordBatch]) -> None:
        nonlocal end
        words_ = pa.concat_arrays([x.column(c) for c in ("word_a", "word_b") for x in some]).dictionary_encode()
        known = np.array([number.setdefault(x, len(number)) for x in words_.dictionary.to_pylist()], np.int64)
        end = np.concatenate([end, np.arange(len(end), len(number))])
        a, b = known[np.asarray(words_.indices)].reshape(2, -1)
        linked = np.concatenate([x.column("linked").to_numpy(zero_copy_only=False) for x in some])
        united(a[linked], b[linked])

    some, rows = [], 0
    for batch in batches:
        some.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            added(some)
            some, rows = [], 0
            if len(number) > WORDS_AT_ONCE:
                yield stars()
                number.clear()
                end = np.zeros(0, np.int64)
    if rows:
        added(some)
    if number:
        yield stars()


def keyword_clusters(pairs: DataFrame, min_lift: float = 1.0, min_support: int = 2) -> DataFrame:
    """A8 (clusters): connected components of the keyword graph whose edges
    are pairs with ``lift > min_lift`` and ``support >= min_support``; each
    word of a pair gets the smallest word of its component as ``cluster``.

    The pairs are read once and not written: each task keeps the components
    of its own pairs and stores one row per word, the word with an end of its
    component there. Each round hooks every word to its smallest neighbour
    where that is smaller, follows the hooks to their ends (over the words
    alone, by pointer jumping) and goes on with the edges between different
    ends, which are far fewer. An end is the smallest word of what hangs on
    it, so the last end is the smallest of the component. The words are
    broadcast only where a count proves them small.
    """
    linked = (F.col("lift") > min_lift) & (F.col("support") >= min_support)
    pairs = stored(pairs.select("word_a", "word_b", F.coalesce(linked, F.lit(False)).alias("linked"))
                   .mapInArrow(_stars, "word_a string, word_b string, linked boolean"), "keyword-edges")
    ends = F.array(F.struct(F.col("word_a").alias("word"), F.when(F.col("linked"), F.col("word_b")).alias("near")),
                   F.struct(F.col("word_b").alias("word"), F.when(F.col("linked"), F.col("word_a")).alias("near")))

    def hooks(edges: DataFrame) -> DataFrame:
        near = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(F.min("near").alias("near"))
        return materialize(near.select("word", F.least("word", F.coalesce("near", "word")).alias("cluster")))

    def follow(step: DataFrame, side) -> DataFrame:
        while True:
            up = side(step.select(F.col("word").alias("cluster"), F.col("cluster").alias("up")))
            nxt = materialize(step.join(up, "cluster").select("word", F.col("up").alias("cluster"), (F.col("up") < F.col("cluster")).alias("_moved")))
            step = nxt.drop("_moved")
            if nxt.filter("_moved").isEmpty():
                return step

    step = hooks(pairs)
    side = F.broadcast if step.count() <= VOCABULARY_ROWS else (lambda x: x)
    labels = step = follow(step, side)
    edges = pairs.filter("linked")
    while True:
        for end in ("word_a", "word_b"):
            edges = edges.join(side(step.select(F.col("word").alias(end), F.col("cluster").alias("_up"))), end).drop(end).withColumnRenamed("_up", end)
        edges = stored(edges.filter("word_a <> word_b").select("word_a", "word_b", "linked").distinct(), "keyword-left")
        if edges.isEmpty():
            return labels
        step = follow(hooks(edges), side)
        up = side(step.select(F.col("word").alias("cluster"), F.col("cluster").alias("_up")))
        labels = materialize(labels.join(up, "cluster", "left").select("word", F.coalesce("_up", "cluster").alias("cluster")))


def concentration(df: DataFrame, entity_col: str, group_cols: list[str] = (),
                  digits: int = 6, top_n: int = 3) -> DataFrame:
    """Entity concentration per group: entities, records, top entity and
    its share, the share of the ``top_n`` largest entities, and the
    Herfindahl index sum(share^2).

    Aggregated in two stages (per entity, then per group) with no
    ``collect_list``; the top-n sum takes ``row_number() <= top_n`` per group,
    which Spark limits per task before the shuffle. A dominant entity or
    group never lands whole in one task.
    """
    g = list(group_cols)
    per = df.filter(F.col(entity_col).isNotNull()).groupBy(*g, entity_col).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("n").alias("n_records"),
        F.sum(F.col("n") * F.col("n")).alias("_ss"),
        F.min_by(F.col(entity_col), F.struct((-F.col("n")).alias("a"), F.col(entity_col).alias("b"))).alias("top_entity"),
        F.max("n").alias("top_n"),
    )
    w = Window.partitionBy(*g).orderBy(F.col("n").desc(), F.col(entity_col).asc())
    topn = (per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n)
            .groupBy(*g).agg(F.sum("n").alias("_topn")))
    if g:
        out = out.join(topn, g)
    else:
        out = out.withColumn("_topn", topn.select("_topn").scalar())
    total = F.col("n_records").cast("double")
    return out.select(
        *g, "n_entities", "n_records", "top_entity",
        F.round(F.col("top_n") / total, digits).alias("top_share"),
        F.round(F.col("_topn") / total, digits).alias(f"top{top_n}_share"),
        F.round(F.col("_ss") / (total * total), digits).alias("hhi"),
    )


def outliers(df: DataFrame, value_col: str, group_cols: list[str] = (), k: float = 3.0,
             id_cols: list[str] = (), digits: int = 6, max_groups: int = 100_000) -> DataFrame:
    """A10: rows more than ``k`` sample standard deviations from their group
    mean. Group statistics are aggregated first, then joined back (broadcast
    when the number of groups is checked to be small)."""
    g = list(group_cols)
    stats = df.groupBy(*g).agg(F.avg(value_col).alias("_mean"), F.stddev_samp(value_col).alias("_sd"))
    if g:
        joined = join_small(df, stats, g, "inner", max_rows=max_groups)
    else:
        joined = (df.withColumn("_mean", stats.select("_mean").scalar())
                    .withColumn("_sd", stats.select("_sd").scalar()))
    dev = F.abs(F.col(value_col) - F.col("_mean"))
    return joined.filter((F.col("_sd") > 0) & (dev > k * F.col("_sd"))).select(
        *id_cols, *g, F.col(value_col),
        F.round(F.col("_mean"), digits).alias("group_mean"),
        F.round(F.col("_sd"), digits).alias("group_std"),
        F.round((F.col(value_col) - F.col("_mean")) / F.col("_sd"), digits).alias("z"))


def data_gaps(df: DataFrame, fields: list[str], group_cols: list[str] = (),
              digits: int = 6) -> DataFrame:
    """Per group x field: rows, missing (NULL), placeholder (empty,
    ``N/A``, pending), their rate, distinct non-null values and the share of
    the most common value. One ``unpivot``, then two aggregation stages keyed
    by a 128-bit digest of the value (long texts are not shuffled whole)."""
    g = list(group_cols)
    stacked = df.select(*g, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        g, fields, "field", "value")
    per_value = stacked.groupBy(*g, "field", F.md5("value").alias("_vk")).agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.col("value").isNull()).alias("_null"),
        F.first(F.col("value").isin(*PLACEHOLDERS)).alias("_ph"))
    out = per_value.groupBy(*g, "field").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("_ph"), F.col("n"))), F.lit(0)).alias("n_placeholder"),
        F.count_if(~F.col("_null")).alias("n_distinct"),
        F.max(F.when(~F.col("_null"), F.col("n"))).alias("_top"))
    rows = F.col("n_rows").cast("double")
    return out.select(
        *g, "field", "n_rows", "n_missing", "n_placeholder",
        F.round((F.col("n_missing") + F.col("n_placeholder")) / rows, digits).alias("gap_rate"),
        "n_distinct",
        F.round(F.coalesce(F.col("_top"), F.lit(0)) / rows, digits).alias("top_value_share"))


GAP_QUESTION = ("Field '%s' is missing or a placeholder in %.1f%% of %d records for %s: "
                "which source could fill it?")


def gap_question(profile: DataFrame, group_col: str) -> DataFrame:
    """A11 (question): the widest gap (highest gap rate; ties by group, field)
    fills a question template. One row."""
    top = profile.orderBy(F.col("gap_rate").desc(), F.col(group_col).asc(), F.col("field").asc()).limit(1)
    return top.select(group_col, "field", "gap_rate", F.format_string(
        GAP_QUESTION, F.col("field"), F.col("gap_rate") * 100, F.col("n_rows"),
        F.col(group_col)).alias("question"))


def _first_used(df: DataFrame, group_col: str, columns: list[str], kinds: dict[str, str], name: str) -> DataFrame:
    """Adds ``name``: which of ``columns`` is the first that the row's group
    has a value in anywhere. One column needs no look at the data."""
    if len(columns) < 2:
        return df.withColumn(name, F.lit(columns[0] if columns else None).cast("string"))
    used = df.groupBy(group_col).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    pick = F.coalesce(*[F.when(F.col(f"_n{i}") > 0, F.lit(c)) for i, c in enumerate(columns)])
    used = used.select(F.col(group_col).alias("_site"), pick.alias(name))
    return df.join(used, F.col(group_col).eqNullSafe(F.col("_site")), "left").drop("_site")


def _chosen(columns: list[str], name: str, read) -> Column:
    """The value of the column that ``name`` names."""
    return F.coalesce(*[F.when(F.col(name) == c, read(c)) for c in columns])


def market_brief(records: DataFrame, group_col: str, entity_col: str | None = None,
                 value_col: str | None = None, money_scale: int | None = 6) -> dict[str, DataFrame]:
    """The four brief tables for a records frame. Columns are chosen per
    group (money: price, else salary; text: the first of tags, requirements,
    text, job_title that the group has values in), so sites of different
    shapes can share a frame.

    ``price_distribution`` (A1-A3, A7; the mean is an exact DECIMAL sum at
    ``money_scale`` places), ``keywords`` (A5 dominant + A6 low-density, word
    counts tokenised once and checkpointed), ``concentration`` (A9, when an
    entity column is given) and ``anomalies_and_gaps`` (A11 gap rows and
    A10 outlier rows, told apart by ``kind``).
    """
    from ..functions.text import money_report

    cols, kinds = records.columns, dict(records.dtypes)
    moneys = [value_col] if value_col else [c for c in MONEY_COLUMNS if c in cols]
    texts = [c for c in TEXT_COLUMNS if c in cols]
    out: dict[str, DataFrame] = {}
    money = bool(moneys)
    # a site that lacks the first column has nulls in it and uses the next
    first = _first_used(records, group_col, moneys, kinds, "_money")
    valued = first.withColumn("money_value", _chosen(moneys, "_money", lambda c: money_report(c, kinds[c]))) if money else None
    if money:
        out["price_distribution"] = price_stats(valued, "money_value", [group_col],
                                                decimal_scale=money_scale)
    if texts:
        texted = _first_used(records, group_col, texts, kinds, "_text")
        texted = texted.withColumn("_words", _chosen(texts, "_text", lambda c: F.col(c).cast("string")))
        counts = materialize(keyword_counts(texted, "_words", [group_col]))
        out["keywords"] = top_keywords(counts, [group_col]).withColumn("kind", F.lit("dominant")).unionByName(
            low_keywords(counts, [group_col]).withColumn("kind", F.lit("low_density")))
    if entity_col:
        out["concentration"] = concentration(records, entity_col, [group_col])
    fields = [c for c in cols if c not in (group_col, "scraped_at", "silver_processed_at")]
    gaps = data_gaps(records, fields, [group_col]).withColumn("kind", F.lit("gap"))
    if money:
        anomalies = outliers(valued.filter(F.col("money_value").isNotNull()), "money_value", [group_col],
                             id_cols=[c for c in ("source_url",) if c in cols])
        gaps = gaps.unionByName(anomalies.withColumn("kind", F.lit("outlier")), allowMissingColumns=True)
    out["anomalies_and_gaps"] = gaps
    return out


def write_brief(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """A12 sink: one Parquet table per brief family."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
