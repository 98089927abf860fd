"""Whole-batch word work on Arrow string columns with numpy.

A batch of texts is handled as one byte buffer plus offsets, in slices of at
most ``SLICE_BYTES`` of text (a longer text is a slice of its own), so a
worker's memory is bounded by the slice and by the longest single text (some
ten bytes a byte of text, and 40 a word). Words are maximal runs of
non-separator bytes within one text; each gets a 64-bit hash, made of its
eight-byte pieces (one piece alone never collides with another of its length),
or by BLAKE2 if it is longer than ``LONG`` bytes. Nothing is kept between
slices, and nothing here loops over words in Python but over the long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_DOCS = 1024          # a document index fits into DOC_BITS
DOC_BITS = 10
HASH_SHIFT = np.uint64(DOC_BITS)

#: Byte classes of the two word rules.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply): spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keyed(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants for ``seed``."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(base + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


#: Byte spans above this length are hashed one by one.
LONG = 64
_LENGTH, _SECOND = (np.uint64(int(x)) for x in keyed(7, 2))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Slice:
    """Some texts of a batch: ``data`` (uint8), ``starts``/``ends`` (byte
    offsets of each text) and ``first``, the row of the first text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data = data
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.first = first
        self.n = len(offsets) - 1
        self._padded: dict[bool, np.ndarray] = {}

    def spans(self, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, word ends and the text index of each word."""
        inside = ~sep[self.data]
        if not inside.any():
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        has = self.ends > self.starts
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[self.starts[has]] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[self.ends[has] - 1] = False
        begin = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return begin, end, np.searchsorted(self.ends, begin, side="right")

    def _loads(self, lower: bool) -> np.ndarray:
        """The eight bytes from every place on, zeros after the end."""
        if lower not in self._padded:
            data = np.zeros(len(self.data) + 8, np.uint8)
            data[:-8] = _LOWER[self.data] if lower else self.data
            self._padded[lower] = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        return self._padded[lower]

    def pieces(self, begin: np.ndarray, size: np.ndarray, k: int, lower: bool) -> np.ndarray:
        """The ``k``-th eight bytes of spans that reach beyond 8 * k bytes."""
        return self._loads(lower)[begin + 8 * k] & _FIRST_BYTES[np.minimum(size - 8 * k, 8)]

    def hashes(self, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each byte span."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        size = end - begin
        with np.errstate(over="ignore"):
            first = self.pieces(begin, size, 0, lower)
            out = mix(first + size.astype(np.uint64) * _LENGTH)
            more = np.flatnonzero((size > 8) & (size <= LONG))
            if len(more):
                # Two states, so that no piece can make good what another changed.
                one, two, left = out[more], mix(first[more] ^ _SECOND), np.arange(len(more))
                for k in range(1, LONG // 8):
                    left = left[size[more[left]] > 8 * k]
                    if not len(left):
                        break
                    piece = self.pieces(begin[more[left]], size[more[left]], k, lower)
                    one[left], two[left] = mix(one[left] ^ piece), mix(two[left] + piece * _SECOND)
                out[more] = mix(one + two * _LENGTH)
        long = np.flatnonzero(size > LONG)
        if len(long):
            data = self._loads(lower).base
            view = memoryview(data)
            out[long] = [int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8).digest(), "little")
                         for a, b in zip(begin[long].tolist(), end[long].tolist())]
        return out

    def distinct(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One span of each kind, and the kind of every span. Kinds are told
        apart by their bytes: hashes only propose, every span is compared
        with the one that stands for it."""
        _, at, which = np.unique(self.hashes(begin, end, lower=False), return_index=True, return_inverse=True)
        size, other = end - begin, begin[at][which]
        same, left = size == size[at][which], np.arange(len(begin))
        for k in range(LONG // 8):
            left = left[(size[left] > 8 * k) & same[left]]
            if not len(left):
                break
            same[left] = self.pieces(begin[left], size[left], k, False) == self.pieces(other[left], size[left], k, False)
        for j in np.flatnonzero(same & (size > LONG)).tolist():
            same[j] = self.data[begin[j]:end[j]].tobytes() == self.data[other[j]:other[j] + size[j]].tobytes()
        if same.all():
            return at, which
        raw, kinds, at = self.data.tobytes(), {}, []
        which = np.empty(len(begin), np.int64)
        for j, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
            which[j] = kinds.setdefault(raw[a:b], len(kinds))
            if which[j] == len(at):
                at.append(j)
        return np.array(at), which

    def words(self, lower: bool, sep: np.ndarray = SPACE_SEP) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text index of every word, in order."""
        begin, end, doc = self.spans(sep)
        return self.hashes(begin, end, lower), doc

    def counts(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES, slice_docs: int = SLICE_DOCS) -> Iterator[Slice]:
    """Slices of a string column, in order, covering every row."""
    raw, off = texts_of(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + slice_bytes, side="right")) - 1
        to = min(max(to, at + 1), at + slice_docs, n)
        yield Slice(raw[off[at]:off[to]], off[at:to + 1] - off[at], at)
        at = to


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows within one text, and their start words."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:])
    total = np.zeros(len(at), np.uint64)
    for k, c in enumerate(keyed(n, n)):
        total += words[at + k] * c
    return mix(total), at


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> np.ndarray:
    """The sorted distinct shingles of all texts as ``doc << 54 | hash`` (54
    hash bits). A text of fewer than ``n`` words, but not none, has its whole
    sequence as one shingle."""
    full, at = grams(words, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(doc, short)
        total = count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k, c in enumerate(keyed(1000 + n, n)):
            has = count[short] > k
            total[has] += words[begin[has] + k] * c
        full, owner = np.concatenate([full, mix(total)]), np.concatenate([owner, short])
    key = (owner.astype(np.uint64) << np.uint64(64 - DOC_BITS)) | (full >> HASH_SHIFT)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key


def owner_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - DOC_BITS)).astype(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
