"""Pairs and clusters against plain loops, and what a record is sent."""

from collections import Counter
from itertools import combinations
from random import Random

import pytest

from sitesift.operators import analytics as A


def brute(rows, min_support):
    docs = {}
    for doc, text in rows:
        docs.setdefault(doc, set()).update((text or "").split())
    df = Counter(w for ws in docs.values() for w in ws)
    pairs = Counter(p for ws in docs.values() for p in combinations(sorted(ws), 2))
    return {(a, b, n, round(n * len(rows) / (df[a] * df[b]), 6)) for (a, b), n in pairs.items() if n >= min_support}


def rows_of(seed, n_docs=120, n_words=60):
    rnd = Random(seed)
    pick = lambda: f"w{int(rnd.random() ** 3 * n_words):03d}x"
    rows = [(i, " ".join(pick() for _ in range(rnd.randrange(0, 40)))) for i in range(n_docs)]
    return rows + [(n_docs, None), (n_docs + 1, ""), (0, "w000x w059x"), (3, rows[3][1])]   # repeated ids are one record


@pytest.mark.parametrize("at_once", [4_000_000, 50])
def test_pairs_match_loops(spark, monkeypatch, at_once):
    monkeypatch.setattr(A, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(A, "WORD_GROUPS", 7)
    rows = rows_of(at_once)
    out = A.keyword_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 5).collect()
    got = [tuple(r) for r in out]
    assert len(got) == len(set(got)) and len(got) > 50
    assert {(a, b, n) for a, b, n, _ in got} == {(a, b, n) for a, b, n, _ in brute(rows, 5)}
    want = {(a, b): x for a, b, _, x in brute(rows, 5)}
    assert all(abs(x - want[a, b]) < 1e-5 for a, b, _, x in got)


def test_no_pairs(spark):
    for rows in ([], [(1, "one two")], [(i, "alone") for i in range(9)]):
        assert A.keyword_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 5).count() == 0


def test_a_record_goes_once_to_a_word_group():
    import pyarrow as pa
    ids = [list(range(100)), [3, 60, 61], [99]]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32()))], names=["ids"])
    sent = [(g, x) for out in A._tails([10, 60])([batch]) for g, x in zip(out.column("g").to_pylist(), out.column("ids").to_pylist())]
    assert sorted(sent) == sorted([(0, ids[0]), (1, ids[0][10:]), (2, ids[0][60:]), (0, ids[1]), (2, [60, 61])])


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_match_union_find(spark, seed):
    rnd = Random(seed)
    names = [f"n{i:03d}" for i in range(150)]
    chain = [(f"c{i:02d}", f"c{i + 1:02d}", 9, 2.0) for i in range(0, 40)]
    pairs = chain + [(*sorted(rnd.sample(names, 2)), rnd.randrange(1, 9), rnd.choice([0.5, 2.0, 3.0])) for _ in range(160)]
    parent = {w: w for a, b, _, _ in pairs for w in (a, b)}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w
    for a, b, n, lift in pairs:
        if lift > 1.0 and n >= 2:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    df = spark.createDataFrame(pairs, "word_a string, word_b string, support long, lift double")
    assert {tuple(r) for r in A.keyword_clusters(df).collect()} == {(w, root(w)) for w in parent}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(A, "IDS_AT_LEAST", 100)
    monkeypatch.setattr(A, "STRETCH_IDS", 200)
    monkeypatch.setattr(A, "ROWS_AT_ONCE", 50)


@pytest.mark.parametrize("at_once", [4_000_000, 3200])
def test_pairs_over_several_blocks(spark, monkeypatch, small_blocks, at_once):
    monkeypatch.setattr(A, "PAIRS_AT_ONCE", at_once)
    rows = rows_of(8, 300, 90)
    rows += [(i, "w000x twice w089x") for i in range(9)] + [(7, "twice four w001x")] * 9 + [(i, "four") for i in range(20, 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in A.keyword_pairs(df, "text", "doc_id", 5).collect()]
    want = {(a, b): (n, x) for a, b, n, x in brute(rows, 5)}
    assert len(got) == len(want) and {(a, b): n for a, b, n, _ in got} == {k: n for k, (n, _) in want.items()}
    assert all(abs(x - want[a, b][1]) < 1e-5 for a, b, _, x in got)
    assert not any("four" in r for r in got)           # in more than five rows, but in four records


def test_rows_without_an_id_are_one_record_but_no_frequency(spark, small_blocks):
    rows = [(i, "alpha beta gamma") for i in range(4)] + [(None, "alpha beta"), (None, "alpha gamma"), (4, "alpha beta delta")]
    rows += [(None, "delta epsilon")] * 6 + [(5, "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r)[:3] for r in A.keyword_pairs(df, "text", "doc_id", 5).collect()}
    assert got == {("alpha", "beta", 6)}               # gamma and delta are in fewer than five records with an id


def tree_mb(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file()) / 1e6


def test_ids_are_stored_once_and_pairs_are_not(spark, monkeypatch, tmp_path):
    """Much fewer bytes are stored than a record sent to each group, or the pairs, would take."""
    kept = []
    monkeypatch.setattr(A, "IDS_AT_LEAST", 100)
    monkeypatch.setattr(A, "stored", lambda df, name, by=(), f=A.stored: kept.append((name, f(df, name, by))) or kept[-1][1])
    rnd = Random(5)
    rows = [(i, " ".join(f"v{rnd.randrange(400)}x" for _ in range(60))) for i in range(1500)]
    pairs = A.keyword_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 5)
    assert A.keyword_clusters(pairs, 1.0, 5).count() == 400
    ids = dict(kept)["keyword-ids"].filter("blk >= 0").collect()
    sent = sum(len(r.data) // 4 for r in ids)
    records = sum(len(set(t.split())) for _, t in rows)
    assert sent <= records + 1500 * 8 + len(ids) and len({r.blk for r in ids}) == 8
    edges = dict(kept)["keyword-edges"].count()
    assert edges <= 36 * 400 < pairs.count()


def test_stars_of_more_words_than_a_task_holds(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(A, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(A, "WORDS_AT_ONCE", 6)
    chain = [(f"c{i:02d}", f"c{i + 1:02d}", True) for i in range(30)]
    Random(3).shuffle(chain)
    rows = chain + [("d1", "d2", False), ("d2", "d3", False)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("word_a", "word_b", "linked"), r)) for r in rows[k:k + 2]]) for k in range(0, len(rows), 2)]
    out = [x for batch in A._stars(batches) for x in batch.to_pylist()]
    label = {w: w for r in rows for w in r[:2]}
    assert {r["word_a"] for r in out} == set(label)
    for _ in label:
        for r in out:
            assert r["linked"] == (r["word_a"] != r["word_b"])
            label[r["word_a"]] = label[r["word_b"]] = min(label[r["word_a"]], label[r["word_b"]])
    assert label == {f"c{i:02d}": "c00" for i in range(31)} | {d: d for d in ("d1", "d2", "d3")}


def test_rounding_is_round(spark):
    from pyspark.sql import functions as F
    rnd = Random(4)
    values = [0.0, 0.0000005, 1.0000005, 2.5e-7, 123456.7890125, 1e6, 3.2e9 + 0.1234565, 1 / 3] + [rnd.randrange(1, 9999) * 977 / rnd.randrange(1, 9999) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(A._rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    assert df.filter("a <> b").count() == 0
