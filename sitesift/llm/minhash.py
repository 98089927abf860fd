"""Near-duplicate documents: one-permutation hashing with optimal
densification, banded buckets, star-shaped candidate edges, exact check.

Method. Every distinct 5-word shingle falls by the top bits of its hash into
one of ``BINS`` bins; a bin keeps its smallest hash. An empty bin copies the
first filled bin of its own fixed random order of all bins (optimal
densification: unbiased, and it always ends). ``BANDS`` groups of ``ROWS``
bins are the bucket keys. With 32 bands of 4, two sets of similarity 0.75
share no bucket with probability 5e-6.

Documents with equal shingle sets are one class, found by a 128-bit digest of
the set and linked without comparing. Within a bucket each class is paired
with the bucket's smallest and largest class only (a star, so pairs grow with
the members, not with their square). Pairs are confirmed on the full sets. A
bucket in which a member fails against the smallest class holds more than one
group: with at most ``GROUP`` members all its sets are compared in one task.
The classes of larger mixed buckets are bucketed anew by exact prefix
filtering on their full sets (:func:`prefix_buckets`) and treated alike; what
is still large and mixed then is compared chunk by chunk, leaving out what is
linked already (:func:`compare_families`). So nothing is capped, and no task
gets an unbounded group.

Hot groups: copies collapse in a partial aggregation before any pairing; star
joins have one row a key on one side, which is broadcast for the keys (at most
POPULAR) that more than one row in POPULAR has.

Defined cases: a null or empty text, or one without words, has 0 shingles and
links with nothing. Every input row gives one result row, repeated rows too.
A null doc_id is larger than every number and is kept only where its
component has no doc_id at all or it links with nothing. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._runtime import POPULAR, join_popular, written
from ._words import same_rows
from .components import connected

SHINGLE_WORDS = 5
BINS, BANDS, ROWS = 128, 32, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Tables of digests up to so many rows are broadcast.
BROADCAST_ROWS = 100_000
#: Classes of a mixed bucket that one task compares with each other.
GROUP = 128

SIGNED = "doc_id bigint, th bigint, n_shingles bigint, cls binary, bands array<bigint>"


def _orders() -> np.ndarray:
    """For each bin, the order in which it looks for a filled bin."""
    rng = np.random.Generator(np.random.PCG64(20240))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_ORDERS = _orders()


def signatures(key: np.ndarray, n_docs: int) -> np.ndarray:
    """Bin minima of every text (rows without shingles stay 0)."""
    bits = int(np.log2(BINS))
    cell = key >> np.uint64(64 - T.DOC_BITS - bits)       # text and bin
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    sig = np.zeros((n_docs, BINS), np.uint64)
    filled = np.zeros((n_docs, BINS), bool)
    at = cell[first].astype(np.int64)
    sig.reshape(-1)[at] = key[first] & np.uint64((1 << (64 - T.DOC_BITS)) - 1)
    filled.reshape(-1)[at] = True
    doc, empty = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for step in range(BINS):
        if not len(doc):
            break
        source = _ORDERS[empty, step]
        hit = filled[doc, source]
        sig[doc[hit], empty[hit]] = sig[doc[hit], source[hit]]
        doc, empty = doc[~hit], empty[~hit]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    total = np.zeros((len(sig), BANDS), np.uint64)
    for k, c in enumerate(T.keyed(31, ROWS)):
        total += T.mix(parts[:, :, k] + c) * c
    return T.mix(total + T.keyed(32, BANDS)[None, :])


def set_digest(key: np.ndarray, n_docs: int) -> np.ndarray:
    """A 16-byte digest of each text's shingle set, order-free."""
    value = key & np.uint64((1 << (64 - T.DOC_BITS)) - 1)
    owner = T.owner_of(key)
    count = np.bincount(owner, minlength=n_docs).astype(np.uint64)
    out = np.zeros((n_docs, 2), np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
    for k in range(2):
        if len(owner):
            sums = np.add.reduceat(T.mix(value * T.keyed(40 + k, 1)[0]), begin)
            out[owner[begin], k] = sums
        out[:, k] = T.mix(out[:, k] + count * T.keyed(50 + k, 1)[0])
    return out


def _digest_array(digest: np.ndarray, valid: np.ndarray) -> pa.Array:
    raw = pa.py_buffer(np.ascontiguousarray(digest).tobytes())
    whole = pa.Array.from_buffers(pa.binary(16), len(digest), [None, raw]).cast(pa.binary())
    return pa.compute.if_else(pa.array(valid), whole, pa.scalar(None, pa.binary()))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, th) to one row of SIGNED per document."""
    for batch in batches:
        ids, th = batch.column("doc_id"), batch.column("th")
        for s in T.slices(batch.column("text")):
            words, doc = s.words(lower=True)
            key = T.shingles(words, doc, s.n, SHINGLE_WORDS)
            count = np.bincount(T.owner_of(key), minlength=s.n)
            bands = band_keys(signatures(key, s.n))[count > 0].astype(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([
                ids.slice(s.first, s.n), th.slice(s.first, s.n),
                pa.array(count, pa.int64()),
                _digest_array(set_digest(key, s.n), count > 0),
                T.list_array(bands, np.where(count > 0, BANDS, 0), pa.int64()),
            ], names=["doc_id", "th", "n_shingles", "cls", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, cls) to (cls, shingles as packed 64-bit numbers), for the texts
    that have the digest ``cls``."""
    low = np.uint64((1 << (64 - T.DOC_BITS)) - 1)
    for batch in batches:
        want = batch.column("cls")
        for s in T.slices(batch.column("text")):
            words, doc = s.words(lower=True)
            key = T.shingles(words, doc, s.n, SHINGLE_WORDS)
            cut = np.searchsorted(T.owner_of(key), np.arange(s.n + 1))
            digest = set_digest(key, s.n)
            rows = [(want[s.first + i].as_py(), i) for i in range(s.n)]
            rows = [(c, i) for c, i in rows if digest[i].tobytes() == c]
            yield pa.RecordBatch.from_arrays([
                pa.array([c for c, _ in rows], pa.binary()),
                pa.array([(key[cut[i]:cut[i + 1]] & low).tobytes() for _, i in rows], pa.binary()),
            ], names=["cls", "shingles"])


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) to (a, b, linked): exact similarity of the sets."""
    for batch in batches:
        left, left_at = T.texts_of(batch.column("set_a").cast(pa.large_binary()).view(pa.large_string()))
        right, right_at = T.texts_of(batch.column("set_b").cast(pa.large_binary()).view(pa.large_string()))
        linked = np.zeros(batch.num_rows, bool)
        at = 0
        while at < batch.num_rows:
            both = (left_at - left_at[at]) + (right_at - right_at[at])
            to = int(np.searchsorted(both, 2 * T.SLICE_BYTES, side="right")) - 1
            to = min(max(to, at + 1), at + T.SLICE_DOCS, batch.num_rows)
            keys, size = [], np.zeros(to - at, np.int64)
            for raw, off in ((left, left_at), (right, right_at)):
                n = np.diff(off[at:to + 1]) // 8
                size += n
                owner = np.repeat(np.arange(to - at, dtype=np.uint64), n)
                values = np.frombuffer(raw[off[at]:off[to]].tobytes(), np.uint64)
                keys.append((owner << np.uint64(64 - T.DOC_BITS)) | values)
            key = np.sort(np.concatenate(keys))
            shared = np.bincount(T.owner_of(key[1:][key[1:] == key[:-1]]), minlength=to - at)
            linked[at:to] = 100 * shared >= PERCENT * (size - shared)
            at = to
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def compare_group(table: pa.Table) -> pa.Table:
    """What hangs together inside one group of at most GROUP classes, as stars
    (each class with the smallest one that its links lead to)."""
    table = table.sort_by("cls")
    names = table.column("cls").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    dense = np.cumsum(several) - 1
    keep = several[column]
    present = np.zeros((len(sets), int(several.sum())), np.float32)
    present[np.repeat(np.arange(len(sets)), size)[keep], dense[column[keep]]] = 1
    shared = present @ present.T
    near = 100 * shared >= PERCENT * (size[:, None] + size[None, :] - shared)
    edges, seen = [], set()
    for start in range(len(sets)):
        queue = [] if start in seen else [start]
        seen.update(queue)
        while queue:
            for other in np.flatnonzero(near[queue.pop()]):
                if int(other) not in seen:
                    seen.add(int(other))
                    queue.append(int(other))
                    edges.append((names[start], names[other]))
    return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()),
                     "b": pa.array([b for _, b in edges], pa.binary())})


def _stars(members: DataFrame, name: str) -> DataFrame:
    """Members (bucket, cls, n) of buckets with two classes or more, with the
    bucket's size ``c`` and its smallest and largest member."""
    own = F.struct("cls", "n")
    n_rows = members.count()
    ends = members.groupBy("bucket").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count(F.lit(1)).alias("c"))
    ends = written(ends.filter("c > 1").withColumn("popular", F.col("c") * POPULAR > n_rows), f"{name}-ends")
    return written(join_popular(members, ends, ["bucket"]), name)


def _pairs(spokes: DataFrame) -> DataFrame:
    """Distinct star edges (a, b) whose set sizes allow a link."""
    def edge(a: Column, b: Column) -> Column:
        return F.struct(a["cls"].alias("a"), b["cls"].alias("b"), a["n"].alias("na"), b["n"].alias("nb"))

    own = F.struct("cls", "n")
    edges = spokes.select(F.explode(F.array(edge(F.col("low"), own), edge(own, F.col("high")))).alias("e")).select("e.*")
    return (edges.filter("a <> b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
            .select("a", "b").distinct())


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, shingles) to one row (cls, n, shingle) per shingle."""
    for batch in batches:
        for name, packed in zip(batch.column("cls").to_pylist(), batch.column("shingles").to_pylist()):
            values = np.frombuffer(packed, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(values), pa.binary()), pa.array(np.full(len(values), len(values))),
                pa.array(values)], names=["cls", "n", "shingle"])


def prefix_buckets(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, cls, n): each class under the shingles of its prefix. With a
    set's shingles ordered from the rarest to the commonest, two sets that
    meet the threshold share one of their first ``n - needed + 1``: an exact
    filter. A shingle of one class only can be left out."""
    rows = written(classes.join(sets, "cls").select("cls", "shingles")
                   .mapInArrow(unpacked, "cls binary, n bigint, shingle bigint"), "minhash-shingles")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = rows.join(counts, "shingle")
    in_order = Window.partitionBy("cls").orderBy("f", "shingle")
    # shingles of one class only come first in the order
    place = F.row_number().over(in_order) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cls"))
    needed = F.ceil(F.col("n") * PERCENT / 100)
    return (shared.withColumn("place", place).filter(F.col("place") <= F.col("n") - needed + 1)
            .select(F.col("shingle").alias("bucket"), "cls", "n"))


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes of different sets, some of them
    more than once; ``signed`` is the written result of :func:`sign` over ``docs``."""
    classes = (signed.filter("n_shingles > 0").groupBy("cls")
               .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    banded = written(classes.select("cls", "rep", "n", F.explode("bands").alias("bucket")), "minhash-bands")
    spokes = _stars(banded, "minhash-buckets")

    # Full sets of the classes that share a bucket.
    wanted = written(spokes.select("cls", "rep").distinct(), "minhash-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = written(found.select("text", "cls").mapInArrow(full_sets, "cls binary, shingles binary")
                   .dropDuplicates(["cls"]), "minhash-sets")
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    linked, groups, families = [], [], []

    def resolve(spokes: DataFrame) -> DataFrame | None:
        """Confirm the star edges and set the small mixed buckets aside;
        returns the members of the large mixed ones."""
        pairs = written(_pairs(spokes), "minhash-pairs")
        near = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        tested = written(near.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
                         .mapInArrow(confirm, "a binary, b binary, linked boolean"), "minhash-tested")
        linked.append(tested.filter("linked").select("a", "b"))
        star = spokes.filter("cls <> low.cls").withColumn("a", F.col("low.cls"))
        failed = star.join(linked[-1].withColumnRenamed("b", "cls"), ["a", "cls"], "left_anti")
        mixed = written(failed.select("bucket", "c").distinct(), "minhash-mixed")
        groups.append(spokes.join(mixed.filter(F.col("c") <= GROUP).select("bucket"), "bucket").groupBy("bucket")
                      .agg(F.array_sort(F.collect_list("cls")).alias("g")).select("g"))
        large = mixed.filter(F.col("c") > GROUP).select("bucket")
        return None if large.isEmpty() else spokes.join(large, "bucket")

    rest = resolve(spokes)
    if rest is not None:
        rest = prefix_buckets(rest.select("cls").distinct(), sets)
        rest = resolve(_stars(written(rest, "minhash-prefixes"), "minhash-prefix"))
        if rest is not None:
            known = written(functools.reduce(DataFrame.union, linked), "minhash-known")
            families.append(compare_families(rest, known))
    group = functools.reduce(DataFrame.union, groups).distinct()
    inside = group.select(F.xxhash64("g").alias("g1"), F.hash("g").alias("g2"), F.explode("g").alias("cls"))
    tasks = functools.reduce(DataFrame.unionByName, [inside.withColumn("g3", F.lit(-1)), *families]).join(sets, "cls")
    linked.append(tasks.groupBy("g1", "g2", "g3").applyInArrow(compare_group, "a binary, b binary"))
    return functools.reduce(DataFrame.union, linked)


def compare_families(large: DataFrame, known: DataFrame) -> DataFrame:
    """The classes to compare (cls) for each task (g1, g2, g3) that finds the
    links inside large mixed buckets. Buckets that share classes form a family; its classes are dealt into chunks of about GROUP / 2, and each
    chunk of classes outside the family's largest star so far is compared with
    every chunk, two chunks a task."""
    family = connected(large.select(F.col("low.cls").alias("a"), F.col("cls").alias("b")).distinct())
    family = family.select(F.col("node").alias("cls"), F.col("label").alias("family"))
    centre = known.groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("a"))
    part = family.join(centre, "cls", "left").withColumn("part", F.coalesce("a", "cls")).drop("a")
    sizes = part.groupBy("family", "part").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("family").agg(F.max_by("part", F.struct("c", "part")).alias("main"),
                                       F.ceil(F.sum("c") * 2 / GROUP).cast("int").alias("chunks"))
    dealt = written(part.join(main, "family").withColumn("chunk", F.pmod(F.hash("cls"), F.col("chunks"))), "minhash-family")
    outside = dealt.filter("part <> main")
    tasks = (outside.select("family", "chunk", "chunks").distinct()
             .select("family", F.col("chunk").alias("r"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")))
    one = tasks.join(outside.select("family", F.col("chunk").alias("r"), "cls"), ["family", "r"])
    other = tasks.join(dealt.select("family", F.col("chunk").alias("c"), "cls"), ["family", "c"])
    return one.unionByName(other).distinct().select(F.xxhash64("family").alias("g1"), F.col("r").alias("g2"), F.col("c").alias("g3"), "cls")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component (a class digest;
    null without shingles) and component_id of every row of ``docs``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    signed = written(docs.mapInArrow(sign, SIGNED), "minhash-signed")
    linked = written(links(docs, signed), "minhash-links")
    found = connected(linked)
    base = signed.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    named = base.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("label", "cls"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(lowest, "component").select("cls", "component", "component_id")
    rows = signed.select("doc_id", "th", "n_shingles", "cls").join(of_class, "cls", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "th", "n_shingles", "component", own.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return classified(docs).select("doc_id", "n_shingles", "component_id",
                                   F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unique_rows(docs: DataFrame) -> DataFrame:
    """One row of each component (its smallest doc_id), all columns as they
    came; rows without shingles all stay. Of rows repeated with id and text
    one stays."""
    found = written(classified(docs).filter("n_shingles > 0").groupBy("component", "doc_id", "th")
                    .agg(F.count(F.lit(1)).alias("copies")), "minhash-rows")
    first = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("c"))
    first = written(first.withColumn("popular", F.col("c") * POPULAR > found.count()).drop("c"), "minhash-first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    judged = join_popular(found, first, ["component"]).select("doc_id", "th", "copies", stays.alias("stays"))
    out = written(judged.filter("not stays or copies > 1"), "minhash-out")
    row = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("th"))
    single = row.join(out, same_rows(row, out), "left_anti").select("_row")
    repeated = out.filter("stays").select("doc_id", "th")
    if not repeated.isEmpty():
        some = row.join(repeated, same_rows(row, repeated), "left_semi")
        single = single.unionByName(some.groupBy("doc_id", "th").agg(F.first("_row").alias("_row")).select("_row"))
    return single.select("_row.*")
