"""Elias-Fano coded monotone sequences on a byte buffer, read with numpy.

The low bits of each value are packed at a fixed width, the high bits are
unary in one bit vector. Every ``BLOCK``-th value is also stored plainly: it
tells where in the bit vector a block begins. So any value is read alone, by
selecting its bit from there on, and a search looks at the plain values of a
stretch and then at the bits of one block; nothing is decoded that was not
asked for. The buffer can be a memory map."""

from __future__ import annotations

import numpy as np

BLOCK = 16
_ENCODED = 1 << 16
#: Words of high bits that are read for all queries at once before the blocks of those left are taken one by one.
PATIENCE = 8


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, below 2**63."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
    low = [b""]
    for a in range(0, n if width else 0, _ENCODED):
        part = values[a:a + _ENCODED, None] >> np.arange(width, dtype=np.uint64)[None, :]
        low.append(np.packbits((part & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little").tobytes())
    low.append(bytes(16))
    high = np.zeros((top >> width) + n + 1, np.uint8)
    high[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
    packed = [values[::BLOCK].tobytes(), b"".join(low), np.packbits(high, bitorder="little").tobytes() + bytes(16)]
    head = np.array([n, width, *map(len, packed)], np.int64).tobytes()
    return head + b"".join(p + bytes(-len(p) % 8) for p in packed)


def _in_byte() -> np.ndarray:
    """Place of the k-th set bit of each byte at [byte, k]."""
    table = np.zeros((256, 8), np.uint8)
    for k, bit in np.argwhere(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")):
        table[k, np.count_nonzero(k & ((1 << np.arange(bit)) if bit else 0))] = bit
    return table


_IN_BYTE = _in_byte()
_ODD, _QUADS, _NIBBLES, _EACH, _TOPS = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
_1, _2, _4, _7, _8, _56 = (np.uint64(x) for x in (1, 2, 4, 7, 8, 56))


def _nth_one(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the ``nth`` (from 0) set bit of each word: the byte by running
    counts in all eight bytes at once, the bit by a table."""
    nth = nth.astype(np.uint64)
    ones = word - ((word >> _1) & _ODD)
    ones = (ones & _QUADS) + ((ones >> _2) & _QUADS)
    ones = ((ones + (ones >> _4)) & _NIBBLES) * _EACH           # set bits up to and with each byte
    byte = np.bitwise_count((((nth * _EACH) | _TOPS) - ones) & _TOPS).astype(np.uint64) * _8
    before = ((ones << _8) >> byte) & np.uint64(255)
    return byte.astype(np.int64) + _IN_BYTE[(word >> byte) & np.uint64(255), nth - before]


class Sequence:
    def __init__(self, buffer: np.ndarray, at: int = 0):
        head = buffer[at:at + 40].view(np.int64)
        self.n, self.width = int(head[0]), int(head[1])
        parts, at = [], at + 40
        for size in head[2:]:
            parts.append(buffer[at:at + int(size)])
            at += int(size) + (-int(size) % 8)
        self.end = at
        self.samples = parts[0].view(np.uint64)
        self._raw = parts[2]
        # eight bytes from any byte on
        self._low, self._high = (np.ndarray((max(len(p) - 7, 0),), "<u8", p, 0, (1,)) for p in parts[1:])

    def _bits(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The high bits from each place on, and how many of them these are."""
        shift = place & 7
        byte = np.minimum(place >> 3, len(self._high) - 1)
        return self._high[byte] >> shift.astype(np.uint64), 64 - shift

    def _ones(self, block: int) -> np.ndarray:
        """Places of a block's values in the high bits, however far apart."""
        first = block * BLOCK
        start = int(self.samples[block] >> np.uint64(self.width)) + first
        last = block + 1 == len(self.samples)
        stop = 8 * len(self._raw) if last else int(self.samples[block + 1] >> np.uint64(self.width)) + first + BLOCK
        bits = np.unpackbits(self._raw[start >> 3:-(-stop // 8)], bitorder="little")[start & 7:]
        return start + np.flatnonzero(bits)[:min(BLOCK, self.n - first)]

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        bit = index * self.width
        return (self._low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def take(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        index = index.astype(np.int64)
        block = index // BLOCK
        nth = index - block * BLOCK
        place = (self.samples[block] >> np.uint64(self.width)).astype(np.int64) + block * BLOCK
        left = np.arange(len(index))
        for _ in range(PATIENCE):
            bits, valid = self._bits(place[left])
            ones = np.bitwise_count(bits).astype(np.int64)
            here = nth[left] < ones
            done = left[here]
            place[done] += _nth_one(bits[here], nth[done])
            left, ones, valid = left[~here], ones[~here], valid[~here]
            nth[left] -= ones
            place[left] += valid
            if not len(left):
                break
        for b in np.unique(block[left]).tolist():
            own = left[block[left] == b]
            place[own] = self._ones(b)[index[own] - b * BLOCK]
        return ((place - index).astype(np.uint64) << np.uint64(self.width)) | self._lows(index)

    def _block(self, wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the blocks ``first`` to ``last`` the last that begins at or
        below each wanted value (or ``first``)."""
        low, high = first.copy(), last.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left] + 1) >> 1
            below = self.samples[middle] <= wanted[left]
            low[left] = np.where(below, middle, low[left])
            high[left] = np.where(below, high[left], middle - 1)
            left = left[low[left] < high[left]]
        return low

    def search(self, wanted: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value in its stretch ``begin`` to ``end`` (excluded;
        all by default), -1 where it is not there, in a sequence of distinct
        values."""
        found = np.full(len(wanted), -1, np.int64)
        begin = np.zeros(len(wanted), np.int64) if begin is None else begin.astype(np.int64)
        end = np.full(len(wanted), self.n, np.int64) if end is None else end.astype(np.int64)
        asked = np.flatnonzero(begin < end)
        wanted, begin, end = wanted[asked].astype(np.uint64), begin[asked], end[asked]
        block = self._block(wanted, begin // BLOCK, (end - 1) // BLOCK)
        width = np.uint64(self.width)
        start = (self.samples[block] >> width).astype(np.int64)
        zeros = (wanted >> width).astype(np.int64) - start        # to pass before values with these high bits
        place, index = start + block * BLOCK, block * BLOCK
        stop = np.minimum(end, index + BLOCK)
        # Past the zeros: ``index`` becomes the first value with the wanted high bits, ``place`` its bit.
        left = np.flatnonzero(zeros > 0)
        target = start + zeros
        for _ in range(PATIENCE):
            if not len(left):
                break
            bits, valid = self._bits(place[left])
            ones = np.bitwise_count(bits).astype(np.int64)
            here = zeros[left] <= valid - ones
            done = left[here]
            at = _nth_one(~bits[here], zeros[done] - 1) + 1
            place[done] += at
            index[done] += at - zeros[done]
            left, ones, valid = left[~here], ones[~here], valid[~here]
            zeros[left] -= valid - ones
            index[left] += ones
            place[left] += valid
            left = left[index[left] < stop[left]]
        for b in np.unique(block[left]).tolist():
            own, at = left[block[left] == b], self._ones(b)
            index[own] = b * BLOCK + np.searchsorted(at - np.arange(b * BLOCK, b * BLOCK + len(at)), target[own])
            place[own] = target[own] + index[own]
        low = wanted & np.uint64((1 << self.width) - 1)
        left = np.flatnonzero((target >= start) & (index < stop))
        while len(left):
            same = (self._bits(place[left])[0] & np.uint64(1)).astype(bool)        # still the wanted high bits
            left = left[same]
            value = self._lows(index[left])
            hit = left[value == low[left]]
            found[asked[hit]] = np.where(index[hit] >= begin[hit], index[hit], -1)
            left = left[value < low[left]]
            index[left] += 1
            place[left] += 1
            left = left[index[left] < stop[left]]
        return found
