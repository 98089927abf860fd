"""Language-model scoring with a compressed n-gram trie.

Level 1 holds every training word: its 64-bit hash (Elias-Fano; a word's id is
its place) and the running sum of counts (Elias-Fano; exact counts are its
differences). Level 2 holds the successors of each word that were seen at
least ``cutoff`` times (1: every one): a monotone Elias-Fano pointer per
context to its range of successors, the successor ids relative to their
context (context number times the vocabulary plus id, so the whole level is
one monotone sequence), and one byte each for the smoothed log probability and
the context's back-off mass. A query reads its context's two pointers and
searches the successor between them, value by value, without decoding what
lies around (``elias_fano``). Level 3 (``order=3``) is built and searched
alike; its contexts are the pairs of level 2 by their place there, and its
bytes are the discounted share and the mass that is left to level 2.

Probabilities: absolute discounting, interpolated with the unigram level:
p(w|c) = (n(c,w) - D) / n(c) + g(c) p1(w), where g(c) is all that is left over
(also of the pairs under the cutoff), so every context sums to one. p1 is the
additive unigram of the contract's base score. With order 3,
p(w|b,c) = (n(b,c,w) - D) / n(b,c) + g(b,c) p(w|c); the first word of a text
has only its start as context, and a pair that is not stored leaves p(w|c).

Scale. Counts are gathered by sorted blocks: each task sums its own keys,
sends one block per shard, and one task per shard merges them and writes the
shard's files to the shared folder under a name of its own, moved into place
when whole: a lost task just runs again. The number of shards follows the
input. Scoring tasks map the files into memory and read single values, so
neither a worker's memory nor the cost of a query grows with the model (but
for the logarithm of a context's successors). Where the shared folder has no
file path, a worker copies a shard into an unlinked temporary file first.

Defined cases: a null text is empty and has only its end token. Rows repeated
with their id count and are scored each; a null doc_id is held out by no one:
it trains. A word never seen in training has count 0, no successors, and backs
off at no cost. Without training rows every score is 0. Other columns are
ignored. An empty table gives an empty result. A text of any length is one
step of its own; its arrays take some 100 bytes a word. Word ids need fewer
than 2**32 - 2 distinct words, and keys of level 3 (pairs times words) less
than 2**64: beyond either, ``build`` raises.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import elias_fano
from ._runtime import scratch

DISCOUNT = 0.75
ADD = 0.1
#: Text bytes per shard of the counts, and per counting or scoring step.
SHARD_BYTES = 48 << 20
#: Contexts of a shard of level 3.
SHARD_PAIRS = 1 << 19
STEP_BYTES = 4 << 20
#: Distinct keys a counting task holds before it sends them.
HOLD = 3_000_000
#: Tokens whose counts surely fit 32 bits.
FITS = 1 << 31

END = np.uint64(0x7E57_0F_7E47 | (1 << 62))         # hash of the end token
LIMIT = np.uint64((1 << 63) - 1)                     # hashes fit a monotone sequence of signed size

BLOCKS = "shard int, keys binary, counts binary"


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return doc_id.isNotNull() & (F.pmod(crc, F.lit(10)) == 0)


def _steps(column: pa.Array) -> Iterator[T.Slice]:
    return T.slices(column, STEP_BYTES, 1 << 30)


def tokens(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every token: the words, then one end."""
    words, doc = s.words(lower=True)
    own = np.concatenate([doc, np.arange(s.n)])
    order = np.argsort(own, kind="stable")
    return np.concatenate([words & LIMIT, np.full(s.n, END)])[order], own[order]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them."""
    which, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[which]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their differences, which compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def gathered(keys_of: Callable[[T.Slice], np.ndarray], shard_of: Callable[[np.ndarray], np.ndarray]):
    """An Arrow function that sums the keys of its texts and emits a block per
    shard; ``shard_of`` gives the shards of sorted keys, which never fall."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tokens_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(*map(np.concatenate, zip(*held)))
            held.clear()
            used, first = np.unique(shard_of(keys), return_index=True)
            for k, a, b in zip(used.tolist(), first, [*first[1:], len(keys)]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([k], pa.int32()), pa.array([_packed(keys[a:b])], pa.binary()),
                    pa.array([counts[a:b].astype(np.uint32).tobytes()], pa.binary())], names=["shard", "keys", "counts"])

        for batch in batches:
            for s in _steps(batch.column("text")):
                keys, which = _distinct(keys_of(s))
                held.append((keys, np.bincount(which, minlength=len(keys))))
                tokens_held += len(which)
                if sum(len(h[0]) for h in held) > HOLD or tokens_held > FITS:
                    yield from flush()
                    tokens_held = 0
        if held:
            yield from flush()
    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([_unpacked(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    return _summed(keys, counts.astype(np.int64))


def _store(folder: str, name: str, data: bytes) -> None:
    where, path = pafs.FileSystem.from_uri(folder)
    where.create_dir(path)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        f.write(data)
    where.move(part, f"{path}/{name}")


_OPEN: dict[str, np.ndarray] = {}


def _mapped(folder: str, name: str) -> np.ndarray:
    key = f"{folder}/{name}"
    if key not in _OPEN:
        where, path = pafs.FileSystem.from_uri(folder)
        if isinstance(where, pafs.LocalFileSystem):
            _OPEN[key] = np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r"))
        else:
            with tempfile.TemporaryFile() as copy, where.open_input_stream(f"{path}/{name}") as f:
                while part := f.read(1 << 20):
                    copy.write(part)
                copy.flush()
                _OPEN[key] = np.asarray(np.memmap(copy, np.uint8, "r"))
    return _OPEN[key]


@dataclass
class Trie:
    """What a worker needs to read the files: the folder, the number of hash
    bits that choose a shard, and per shard how many words and, for a third
    level, how many pairs it holds; ``span`` pairs are a shard of that level."""
    folder: str
    bits: int
    sizes: list[int]
    total: int
    pairs: list[int] = field(default_factory=list)
    span: int = SHARD_PAIRS

    @property
    def words(self) -> int:
        return sum(self.sizes)

    def shard_of_hash(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(63 - self.bits)).astype(np.int64)

    def first_ids(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def _level1(self, shard: int) -> tuple[elias_fano.Sequence, elias_fano.Sequence]:
        data = _mapped(self.folder, f"words-{shard}")
        hashes = elias_fano.Sequence(data)
        return hashes, elias_fano.Sequence(data, hashes.end)

    def lookup(self, wanted: np.ndarray, with_counts: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: never seen) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        first = self.first_ids()
        cut = np.searchsorted(self.shard_of_hash(wanted), np.arange(len(self.sizes) + 1))
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a == b or not self.sizes[k]:
                continue
            hashes, sums = self._level1(k)
            at = hashes.search(wanted[a:b])
            ids[a:b] = np.where(at >= 0, at + first[k], -1)
            if with_counts:
                hit = at[at >= 0]
                counts[a:b][at >= 0] = (sums.take(hit + 1) - sums.take(hit)).astype(np.int64)
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted word ids."""
        out, first = np.zeros(len(ids), np.int64), self.first_ids()
        cut = np.searchsorted(ids, first)
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a < b:
                sums = self._level1(k)[1]
                at = ids[a:b] - first[k]
                out[a:b] = (sums.take(at + 1) - sums.take(at)).astype(np.int64)
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.total + ADD * (self.words + 1))

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Shard of each context id; the start of a text, id ``words``, and
        with it the last shard's end, go to the last shard."""
        return np.clip(np.searchsorted(self.first_ids(), ids, side="right") - 1, 0, len(self.sizes) - 1)

    def first_pairs(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.pairs, dtype=np.int64)])

    def triples(self, place: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Keys of level 3: the context pair's place times the vocabulary,
        plus the second word of ``pairs`` (unseen: the start, which follows
        nothing)."""
        word = np.minimum(pairs & np.uint64(0xFFFFFFFF), np.uint64(self.words))
        return place.astype(np.uint64) * np.uint64(self.words + 1) + word

    def shard_of_triple(self, keys: np.ndarray) -> np.ndarray:
        return (keys // np.uint64((self.words + 1) * self.span)).astype(np.int64)

    def thirds(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct keys of level 3: the discounted share (0: not
        stored) and the mass that the context leaves to level 2."""
        share, left = np.zeros(len(keys)), np.ones(len(keys))
        size = np.uint64(self.words + 1)
        shard = self.shard_of_triple(keys)
        used, first = np.unique(shard, return_index=True)
        for k, a, b in zip(used.tolist(), first, [*first[1:], len(keys)]):
            level = _Level(_mapped(self.folder, f"triples-{k}"))
            wanted = keys[a:b] - np.uint64(k * self.span) * size
            at, back = level.find(wanted, (wanted // size).astype(np.int64))
            left[a:b] = 10 ** back
            share[a:b][at >= 0] = 10 ** level.probability(at[at >= 0])
        return share, left

    def successors(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct pairs ``context << 32 | id``: the log10
        probability (nan: not stored), the log10 back-off of the context, and
        the place in level 2 (-1: not stored)."""
        prob, back, place = np.full(len(pairs), np.nan), np.zeros(len(pairs)), np.full(len(pairs), -1, np.int64)
        before = self.first_pairs() if self.pairs else np.zeros(len(self.sizes) + 1, np.int64)
        ctx, word = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
        first = self.first_ids()
        shard = self.contexts(ctx)
        cut = np.searchsorted(shard, np.arange(len(self.sizes) + 1))
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a == b:
                continue
            level = _Level(_mapped(self.folder, f"pairs-{k}"))
            local = ctx[a:b] - first[k]
            # an unseen word follows nothing: it reads as the start of a text
            wanted = local.astype(np.uint64) * np.uint64(self.words + 1) + np.minimum(word[a:b], np.uint64(self.words))
            at, back[a:b] = level.find(wanted, local)
            prob[a:b][at >= 0] = level.probability(at[at >= 0])
            place[a:b] = np.where(at >= 0, at + before[k], -1)
        return prob, back, place


class _Level:
    """Pointers, context-relative ids, then two byte arrays with their range."""

    def __init__(self, data: np.ndarray):
        self.pointers = elias_fano.Sequence(data)
        self.ids = elias_fano.Sequence(data, self.pointers.end)
        at = self.ids.end
        self.range = data[at:at + 32].view(np.float64)
        self.p = data[at + 32:at + 32 + self.ids.n]
        self.g = data[at + 32 + self.ids.n:at + 32 + self.ids.n + self.pointers.n - 1]

    def find(self, wanted: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each successor (``wanted``: context number times the
        vocabulary plus id) between its context's pointers (-1: not stored),
        and the log10 back-off of its context; ``local`` is sorted."""
        first = np.flatnonzero(np.diff(local, prepend=-1))
        one, size = local[first], np.diff(np.append(first, len(local)))
        begin, end = self.pointers.take(one), self.pointers.take(one + 1)
        return self.ids.search(wanted, np.repeat(begin, size), np.repeat(end, size)), np.repeat(self.backoff(one), size)

    def probability(self, places: np.ndarray) -> np.ndarray:
        return self.range[0] + self.p[places] * (self.range[1] / 255)

    def backoff(self, local: np.ndarray) -> np.ndarray:
        return self.range[2] + self.g[local] * (self.range[3] / 255)


def _quantised(values: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Bytes on an even scale of log10 values; [least, width of the range]."""
    if not len(values):
        return np.zeros(0, np.uint8), [0.0, 0.0]
    low, span = float(values.min()), float(values.max() - values.min())
    return np.rint((values - low) * (255 / span if span else 0)).astype(np.uint8), [low, span]


def _level(local: np.ndarray, word: np.ndarray, logs: np.ndarray, left: np.ndarray, words: int) -> bytes:
    """A file of ``_Level``: successors sorted by context (``local``) and
    word, with their log10 values, and the mass ``left`` of every context."""
    pq, p_range = _quantised(logs)
    gq, g_range = _quantised(np.log10(np.maximum(left, 1e-9)))
    pointers = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(left)))])
    ids = local.astype(np.uint64) * np.uint64(words + 1) + word.astype(np.uint64)
    data = elias_fano.encode(pointers) + elias_fano.encode(ids) + np.array([*p_range, *g_range]).tobytes()
    return data + pq.tobytes() + gq.tobytes()


def build(docs: DataFrame, order: int = 3, cutoff: int = 1) -> Trie:
    """Count the training rows of ``docs(doc_id, text)`` and write the trie
    with levels up to ``order`` (2 or 3). Successors seen less than ``cutoff``
    times are not stored: 1 stores every one."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    spark = docs.sparkSession
    train = docs.filter(~held_out(F.col("doc_id"))).select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size) // SHARD_BYTES).bit_length())
    folder = scratch(spark, "trie")
    empty = Trie(folder, bits, [0] * (1 << bits), 0)

    def counted(keys_of, shard_of, shards: int, write, schema: str) -> list:
        # Every shard gets a file: an empty block each stands beside what was counted.
        none = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
        blocks = train.mapInArrow(gathered(keys_of, shard_of), BLOCKS).unionByName(none)
        return blocks.groupBy("shard").applyInArrow(write, schema).collect()     # a row per shard

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        hashes, counts = _merged(table)
        sums = np.concatenate([[0], np.cumsum(counts)])
        _store(folder, f"words-{shard}", elias_fano.encode(hashes) + elias_fano.encode(sums))
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(hashes)], pa.int64()),
                         "total": pa.array([int(sums[-1])], pa.int64())})

    made = counted(lambda s: tokens(s)[0], empty.shard_of_hash, 1 << bits, write_words, "shard int, words bigint, total bigint")
    sizes = [0] * (1 << bits)
    for r in made:
        sizes[r["shard"]] = r["words"]
    trie = Trie(folder, bits, sizes, sum(r["total"] for r in made))
    if not trie.total:
        return trie
    if trie.words >= 0xFFFFFFFE:
        raise ValueError(f"{trie.words} distinct words: word ids have 32 bits")

    def write_pairs(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        pairs, counts = _merged(table)
        begin = trie.first_ids()[shard]
        n_ctx = sizes[shard] + (shard == len(sizes) - 1)       # the last one also holds the start
        local = (pairs >> np.uint64(32)).astype(np.int64) - begin
        seen = np.bincount(local, counts, minlength=n_ctx)     # n(c), all pairs
        kept = counts >= cutoff
        local, counts = local[kept], counts[kept]
        word = (pairs[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        share = (counts - DISCOUNT) / seen[local]
        left = 1 - np.bincount(local, share, minlength=n_ctx)
        one, which = np.unique(word, return_inverse=True)
        p = share + left[local] * trie.unigram(trie.counts_of(one))[which]
        _store(folder, f"pairs-{shard}", _level(local, word, np.log10(p), left, trie.words))
        return pa.table({"shard": pa.array([shard], pa.int32()), "pairs": pa.array([len(local)], pa.int64())})

    made = counted(lambda s: _pairs(trie, s)[0], lambda pairs: trie.contexts((pairs >> np.uint64(32)).astype(np.int64)),
                   1 << bits, write_pairs, "shard int, pairs bigint")
    if order == 2:
        return trie
    held = [0] * (1 << bits)
    for r in made:
        held[r["shard"]] = r["pairs"]
    whole = Trie(folder, bits, sizes, trie.total, held, SHARD_PAIRS)
    n_pairs = sum(held)
    if n_pairs * (trie.words + 1) >= 1 << 64:
        raise ValueError(f"{n_pairs} pairs of {trie.words} words: keys of level 3 have 64 bits")

    def triple_keys(s: T.Slice) -> np.ndarray:
        pairs, doc, _ = _pairs(whole, s)
        one, which = _distinct(pairs)
        return _triples(whole, pairs, doc, whole.successors(one)[2][which])[0]

    def write_triples(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _merged(table)
        n_ctx = min(whole.span, n_pairs - shard * whole.span)
        local = (keys // np.uint64(whole.words + 1)).astype(np.int64) - shard * whole.span
        word = (keys % np.uint64(whole.words + 1)).astype(np.int64)
        seen = np.bincount(local, counts, minlength=n_ctx)
        kept = counts >= cutoff
        local, word, counts = local[kept], word[kept], counts[kept]
        share = (counts - DISCOUNT) / seen[local]
        left = 1 - np.bincount(local, share, minlength=n_ctx)
        _store(folder, f"triples-{shard}", _level(local, word, np.log10(share), left, whole.words))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    counted(triple_keys, whole.shard_of_triple, n_pairs // whole.span + 1, write_triples, "shard int")
    return whole


def _triples(trie: Trie, pairs: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of level 3 and the tokens they belong to: those after a pair that
    has a ``place`` in level 2, in the same text."""
    at = 1 + np.flatnonzero((place[:-1] >= 0) & (doc[1:] == doc[:-1]))
    return trie.triples(place[at - 1], pairs[at]), at


def _pairs(trie: Trie, s: T.Slice, with_counts: bool = False):
    """Per token: the pair ``context << 32 | id`` (an unseen context or word
    is 2**32 - 1), its text, and its count where asked for."""
    h, doc = tokens(s)
    one, which = _distinct(h)
    ids, counts = trie.lookup(one, with_counts)
    ids = np.where(ids < 0, 0xFFFFFFFF, ids).astype(np.uint64)[which]
    context = np.concatenate([[np.uint64(trie.words)], ids[:-1]])
    context[np.concatenate([[True], doc[1:] != doc[:-1]])] = trie.words      # the start of a text
    return (context << np.uint64(32)) | ids, doc, counts[which]


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Every row of ``docs`` with its token counts, base and model score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _steps(batch.column("text")):
                pairs, doc, counts = _pairs(trie, s, with_counts=True)
                base = np.log10(trie.unigram(counts))
                model = base.copy()
                known = np.flatnonzero((pairs >> np.uint64(32)) != 0xFFFFFFFF)   # contexts seen in training
                if trie.total and len(known):
                    one, which = _distinct(pairs[known])
                    prob, back, place = trie.successors(one)
                    model[known] = np.where(np.isnan(prob[which]), back[which] + base[known], prob[which])
                    if trie.pairs:
                        own = np.full(len(pairs), -1, np.int64)
                        own[known] = place[which]
                        keys, at = _triples(trie, pairs, doc, own)
                        one, which = _distinct(keys)
                        share, left = trie.thirds(one)
                        model[at] = np.log10(share[which] + left[which] * 10 ** model[at])
                per_doc = lambda w=None: np.bincount(doc, w, minlength=s.n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(s.first, s.n), batch.column("held_out").slice(s.first, s.n),
                    pa.array(per_doc().astype(np.int64)), pa.array(per_doc(counts > 0).astype(np.int64)),
                    pa.array(np.full(s.n, trie.total, np.int64)), pa.array(per_doc(base)), pa.array(per_doc(model)),
                ], names=[f.split()[0] for f in SCORES.split(", ")])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, SCORES)
