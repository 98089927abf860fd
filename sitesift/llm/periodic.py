"""Periodic runs in texts: suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal), at least ``max(min_length, 2 q)`` words long, that no neighbouring
word extends. All runs of every text are found, whatever their period.

Method. The automaton of the words is built; its suffix links form a tree in
which the path from the state of prefix i to the root holds all suffixes of
that prefix. Every node remembers the end of its last occurrence. Reading word
i *accesses* that path: all of it is recoloured i, and the old colours come
off in segments, each with a last end e and the greatest suffix length L that
it holds. Where the distance d = i - e is at most L, two equal stretches of d
words meet: a square of period d ends at i, and it reaches back to i - d - L +
1. The same start and period at the next words extend it to the run. A run's
first square is always seen, as its root is primitive and so did not occur in
between; a period that is a multiple of a smaller one never is. The path is
kept as heavy chains, each a stack of colour segments, so an access costs the
logarithm of the text, amortised, as with link-cut trees.

What is read. A run's words all lie in 6-word grams that occur twice in it
(its length less its period is 6 at least). So every text is cut, batch by
batch with numpy, into islands covered by grams that repeat inside the island,
again and again until nothing falls away; islands are read by the automaton,
one at a time, and a text without any has no run. This is exact: hashes only
choose islands (equal grams have equal hashes), words are compared as bytes,
and a run can't reach beyond its island.

Scale. Texts are handled where the scan puts them: no shuffle, and no state
beyond one slice of a batch. Memory is bounded by the slice, or by the longest
single text (about 100 bytes a word of its longest island, and the arrays of
``_text``).

Defined cases: a null or empty text, or one without words, has no words, no
runs and an empty collapsed text. Repeated rows each give a row. A null doc_id
stays null. Other columns are ignored, whatever their names. An empty table
gives no rows. Words count as equal by their bytes alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Least words of a run.
MIN_LENGTH = 12
JOIN_WORDS = 1 << 16


def islands(word: np.ndarray, owner: np.ndarray, gram: int, least: int) -> list[tuple[int, int]]:
    """[begin, end) of the stretches of words (hashes, texts in ``owner``)
    that are covered by grams found twice in the stretch."""
    place, group = np.arange(len(word)), owner
    while len(place) >= least:
        key, at = T.grams(word[place], group, gram)
        key = T.mix(key + group[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key) + 1, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(place) + 1, np.int64)
        edge[at[twice[:-1]]] += 1
        edge[at[twice[:-1]] + gram] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        new = covered.copy()          # the first word of a stretch
        new[1:] &= ~covered[:-1] | (group[1:] != group[:-1])
        number = np.cumsum(new) - 1
        kept = covered.copy()
        kept[covered] = np.bincount(number[covered])[number[covered]] >= least
        before = len(place)
        place, group = place[kept], number[kept]
        if len(place) == before:
            first = np.flatnonzero(np.diff(group, prepend=-1))
            last = np.append(first[1:], len(place)) - 1
            return [(int(a), int(b) + 1) for a, b in zip(place[first], place[last])]
    return []


class Automaton:
    """Suffix automaton of a sequence: ``length`` and ``link`` of every state
    and the state of each prefix. A state's only step is kept in two arrays,
    further ones in a dictionary."""

    def __init__(self, words: list[int]):
        length, link = array("i", [0]), array("i", [-1])
        word, to = array("i", [-1]), array("i", [0])
        more: dict[int, dict[int, int]] = {}
        self.prefix, last = array("i"), 0

        def put(state: int, w: int, target: int) -> None:
            if word[state] < 0 or word[state] == w:
                word[state], to[state] = w, target
            else:
                more.setdefault(state, {})[w] = target

        for w in words:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            word.append(-1)
            to.append(0)
            p, target = last, -1
            while p >= 0:
                if word[p] == w:
                    target = to[p]
                    break
                if word[p] < 0:
                    word[p], to[p] = w, new
                else:
                    steps = more.get(p)
                    if steps is None:
                        more[p] = {w: new}
                    elif w in steps:
                        target = steps[w]
                        break
                    else:
                        steps[w] = new
                p = link[p]
            if target >= 0:
                if length[target] == length[p] + 1:
                    link[new] = target
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[target])
                    word.append(word[target])
                    to.append(to[target])
                    if target in more:
                        more[copy] = more[target].copy()
                    while p >= 0 and (to[p] if word[p] == w else more.get(p, {}).get(w, -1)) == target:
                        put(p, w, copy)
                        p = link[p]
                    link[target] = link[new] = copy
            last = new
            self.prefix.append(new)
        self.length, self.link = length, link

    def chains(self) -> array:
        """The top state of every state's heavy chain in the link tree."""
        link, order = self.link, np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()
        below, heavy = array("i", [1]) * len(link), array("i", [-1]) * len(link)
        for v in reversed(order[1:]):
            up = link[v]
            below[up] += below[v]
            if heavy[up] < 0 or below[v] > below[heavy[up]]:
                heavy[up] = v
        top = array("i", range(len(link)))
        for v in order[1:]:
            if heavy[link[v]] == v:
                top[v] = top[link[v]]
        return top


def runs_of(words: list[int], least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    tree = Automaton(words)
    length, link, top = tree.length, tree.link, tree.chains()
    segments: dict[int, list[tuple[int, int]]] = {}     # per chain, its top segment last: (greatest length, last end)
    found: dict[tuple[int, int], int] = {}
    for i, v in enumerate(tree.prefix):
        squares: dict[int, int] = {}
        while v > 0:
            head, here = top[v], length[v]
            stack = segments.get(head)
            if stack is None:
                segments[head] = [(here, i)]
            else:
                covered = 0
                while stack and covered < here:
                    longest, end = stack[-1]
                    if longest <= here:
                        stack.pop()
                    covered = min(longest, here)
                    d = i - end
                    if d <= covered and squares.get(d, 0) < covered:
                        squares[d] = covered
                stack.append((here, i))
            v = link[head]
        for d, reach in squares.items():
            found[i - d - reach + 1, d] = i
    return [(s, e - s + 1, q) for (s, q), e in sorted(found.items()) if e - s + 1 >= least]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, ``runs`` (by start, then period) and ``collapsed``:
    the words joined by one space without those that a run holds after its
    first period. ``least``: the fewest words of a run, 4 or more."""
    if least < 4:
        raise ValueError(f"least {least}: 4 or more")
    gram = least // 2          # a run's length less its period is at least half its length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text")):
                raw = s.data.tobytes()
                begin, end, doc = s.spans(T.SPACE_SEP)
                count = s.counts(doc)
                first = np.cumsum(count) - count
                kept = np.ones(len(begin), bool)
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for a, b in islands(s.hashes(begin, end, lower=False), doc, gram, least):
                    names: dict[bytes, int] = {}
                    ids = [names.setdefault(raw[x:y], len(names)) for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]
                    own = int(doc[a])
                    for start, length, period in runs_of(ids, least):
                        kept[a + start + period:a + start + length] = False
                        runs.setdefault(own, []).append((a + start - int(first[own]), length, period))
                texts = []
                for k in range(s.n):
                    at = np.arange(first[k], first[k] + count[k])
                    if k in runs:
                        at = at[kept[at]]
                    texts.append(_joined(raw, begin[at], end[at], k not in runs))
                each = [runs.get(k, []) for k in range(s.n)]
                flat = np.array([r for own in each for r in own], np.int64).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], names=["start", "length", "period"])
                offsets = np.concatenate([[0], np.cumsum([len(own) for own in each])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(s.first, s.n), pa.array(count.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), parts), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def _joined(raw: bytes, begin: np.ndarray, end: np.ndarray, whole: bool) -> str:
    """The words joined by one space, some at a time; ``whole``: none is
    missing between the first and the last."""
    parts = []
    for k in range(0, len(begin), JOIN_WORDS):
        b, e = begin[k:k + JOIN_WORDS], end[k:k + JOIN_WORDS]
        words = raw[b[0]:e[-1]].split() if whole else [raw[x:y] for x, y in zip(b.tolist(), e.tolist())]
        parts.append(b" ".join(words))
    return b" ".join(parts).decode()


def digests(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: the number of runs, the longest one (ties:
    smallest start, then period; nulls without a run) with its exponent in
    thousandths, and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    rank = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(rank)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.l"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("-best.l * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_tails(docs: DataFrame, crc: Column) -> DataFrame:
    """``docs(doc_id, text)`` where every text whose ``crc`` is divisible by
    10 gets a repeating end: with g = crc div 10 and n words, the words from a
    = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them. Other
    texts, and those without words, stay as they are."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", crc.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.when(F.col("p").isNotNull(), F.array_join(F.transform("w", place), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))
