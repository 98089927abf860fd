"""Whitening, mixing and periodic runs: brute force and defined cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitesift.llm import pareto, periodic, whiten
from sitesift.llm import _text as T
from sitesift.session import ship_package


def space_words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def key(row):
    return tuple((x is not None, x) for x in row)


# ---------------------------------------------------------------- runs
def brute_runs(w, least):
    """Every maximal repetition, by its definition."""
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q):
                part = w[start:start + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.add((start, length, q))
            i += 1
    return sorted(found)


def sequences():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(0, 70)
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


def test_runs_against_brute_force():
    for w in sequences():
        for least in (4, 12):
            assert periodic.runs_of(w, least) == brute_runs(w, least)
        hashes, got = T.mix(np.array(w, np.uint64) + np.uint64(7)), []
        for a, b in periodic.islands(hashes, np.zeros(len(w), np.int64), 6, 12):
            got += [(a + s, length, q) for s, length, q in periodic.runs_of(w[a:b])]
        assert sorted(got) == brute_runs(w, 12)


def test_runs_of_documents(spark):
    ship_package(spark)
    texts = [None, "", " \n ", "a", "x y " * 6, "x y " * 5 + "x", "a b c d e f g " * 3 + "tail", "la " * 4000, "\tone two\n" * 9 + "é " * 13,
             " ".join(f"w{i}" for i in range(3000)) + " end" * 12, " ".join(str(i % 500) for i in range(30_000)), "x y " * 6]
    texts += [" ".join(map(str, w)) for w in list(sequences())[:60]]
    df = spark.createDataFrame([(i if i != 3 else None, t, "clash", 0) for i, t in enumerate(texts)],
                               "doc_id bigint, text string, runs string, n_words int")
    got = {}
    for r in periodic.find_runs(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    short = {r.doc_id: r for r in periodic.digests(periodic.find_runs(df)).collect()}
    for i, text in enumerate(texts):
        (r,), w = got[i if i != 3 else None], space_words(text)
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(w)
        if len(w) < 5000:
            assert runs == brute_runs(w, 12)
        else:
            assert runs == [(0, len(w), len(set(w)))]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
        d = short[i if i != 3 else None]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (d.start, d.length, d.period) == (best or (None, None, None)) and d.n_runs == len(runs)
        assert d.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert d.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert d.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()
    assert periodic.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(df, least=3)


def test_planted_tails(spark):
    from pyspark.sql import functions as F
    rows = [(h, " ".join(f"w{i}" for i in range(n))) for h in (0, 7, 10, 1234560, 99990) for n in (0, 1, 2, 50)] + [(10, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.text for r in periodic.with_tails(df, F.col("doc_id")).collect()]
    for (h, text), new in zip(rows, got):
        w = space_words(text)
        if h % 10 or not w:
            assert new == text
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert space_words(new) == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


# ---------------------------------------------------------------- mixing
def fair_targets(sizes, weights, most=3):
    left, share, full = sum(sizes), sum(weights), [False] * len(sizes)
    while True:
        now = [f or w * left > most * s * share for f, s, w in zip(full, sizes, weights)]
        if now == full:
            return [most * s if f else w * left / share for f, s, w in zip(full, sizes, weights)]
        full = now
        left, share = sum(sizes) - sum(most * s for f, s in zip(full, sizes) if f), sum(w for f, w in zip(full, weights) if not f)


def test_mix_targets_copies_and_reruns(spark):
    ship_package(spark)
    rng = random.Random(1)
    names = ["b", None, "a", "ab", "é", "Z", ""]
    rows = [(i, names[0] if i % 3 else rng.choice(names), "w " * int(rng.paretovariate(1) * 20)) for i in range(3000)]
    rows += [(None, "a", "x y z")] * 5 + [(9, "a", "x y z")] * 4 + [(10, "none", None), (11, "none", ""), (12, "b", "long " * 40_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, source string, text string, size string, taken int")
    got = pareto.mix(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len(space_words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weights = [pareto.WEIGHTS[k % 3] for k in range(len(order))]
    want = dict(zip(order, fair_targets([size[s] for s in order], weights)))
    of = {}
    for i, s, t in rows:
        of.setdefault((i, len(space_words(t))), s)
    taken, drawn = Counter(), {}
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken == r.size * r.copies <= 3 * r.size
        assert int(want[s] // max(size[s], 1)) <= r.copies <= int(want[s] // max(size[s], 1)) + 1 or not r.size
        taken[s] += r.taken
        drawn.setdefault(s, []).append(r.copies)
    for s in order:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 5), (s, taken[s], want[s])
    again = pareto.mix(df.repartition(13)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    other = pareto.mix(df, seed=5).collect()
    assert sorted(map(tuple, got), key=key) != sorted(map(tuple, other), key=key)
    assert pareto.mix(df.limit(0)).count() == 0


def test_mix_inclusion_follows_the_odds(spark):
    """Over seeds, every document of a source is drawn equally often."""
    df = spark.createDataFrame([(i, "a" if i < 40 else "b", "w " * 10) for i in range(80)], "doc_id bigint, source string, text string")
    times = Counter()
    for seed in range(8):
        for r in pareto.mix(df, weights=(3, 1), seed=seed).collect():
            times[r.doc_id] += r.copies
    a, b = [times[i] for i in range(40)], [times[i] for i in range(40, 80)]
    assert sum(a) == 8 * 60 and sum(b) == 8 * 20          # 1.5 and 0.5 times the size
    assert 8 <= min(a) and max(a) <= 16 and max(b) <= 8 and len(set(a)) > 3 and len(set(b)) > 3


# ---------------------------------------------------------------- whitening
def plain(vectors, top):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    c = x - x.mean(axis=0)
    values, parts = np.linalg.eigh(c.T @ c / len(c))
    values, parts = values[::-1][:top], parts[:, ::-1][:, :top]
    return x, values, (c @ parts) / np.sqrt(values), np.trace(c.T @ c / len(c))


@pytest.mark.parametrize("shape", ["spread", "close", "flat"])
def test_whitening_against_eigenvectors(spark, shape):
    ship_package(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) @ np.diag({"spread": 2.0 ** -np.arange(12), "close": np.ones(12), "flat": np.ones(12)}[shape])
    if shape == "flat":
        x[:, 3], x[:, 5] = 0.25, x[:, 4]            # a constant entry and a repeated one
    rows = [(i, [float(v) for v in np.float32(r)], "clash") for i, r in enumerate(x)]
    bad = [(900, None, ""), (901, [float("nan")] * 12, ""), (902, [1.0] * 11 + [None], ""), (903, [float("inf")] + [0.0] * 11, ""), (904, [0.5] * 3, "")]
    df = spark.createDataFrame(rows + bad + [rows[0]] * 3, "vec_id bigint, embedding array<float>, component string")
    got = whiten.whiten(df, top=9).toPandas()
    vectors = [r[1] for r in rows + [rows[0]] * 3]
    ints, values, white, trace = plain(vectors, 9)
    assert len(got) == 9 * len(vectors) and set(got.n) == {len(vectors)}
    exact = ((len(ints) * ints - ints.sum(axis=0)).astype(object) ** 2).sum(axis=1)
    for i in (0, 7, 399):
        own = got[got.vec_id == i].sort_values("component")
        assert set(own.deviation) == {exact[i]}
        assert np.allclose(np.abs(own.whitened[:9]) if i else np.abs(own.whitened.to_numpy().reshape(9, -1)[:, 0]), np.abs(white[i]), atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first(), values / trace, rtol=1e-10)
    assert got.identity_error.max() <= 1e-9


def test_whitening_of_little(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whiten.whiten(spark.createDataFrame(rows, kind)).count() == 0
    two = whiten.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (None, [1.0, 1.0])], kind)).collect()
    assert sorted(abs(r.whitened) for r in two) == pytest.approx([1, 1]) and {r.component for r in two} == {1}


def test_bidiagonal_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whiten, "DIRECT", 1)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(rng.normal(size=(300, 5)))]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(6)).toPandas()
    white = plain([r[1] for r in rows], 5)[2]
    assert np.allclose(np.abs(got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()), np.abs(white), atol=1e-8)


def test_squared_distance_is_exact_or_null():
    off = np.array([[3_000_000_000, 1], [1, 2]], np.int64)
    assert whiten._squares(off) == [9_000_000_000_000_000_001 if 9_000_000_000_000_000_001 < 1 << 63 else None, 5]
    assert whiten._squares(np.array([[4_000_000_000, 0], [2, 2]], np.int64)) == [None, 8]
