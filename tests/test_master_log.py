"""S3/D4 with a commit log: snapshots, races, crashes, replay, compaction."""

import os

from pyspark.sql import functions as F

from sitesift.sources import master_log as L

KEYS, HOW = ["domain", "k"], {"ts_col": "ts", "tiebreak": ["v"]}
SCHEMA = "domain string, k string, ts int, v string"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((r.domain, r.k, r.ts, r.v) for r in df.collect()) if df is not None else []


def read(spark, root, **more):
    return rows(L.read(spark, root, KEYS, **HOW, **more))


def merge(df, root, **more):
    return L.merge(df, root, KEYS, **HOW, **more)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_newest_wins_and_older_snapshots_stay(spark, tmp_out):
    root = os.path.join(tmp_out, "m")
    assert L.read(spark, root, KEYS, **HOW) is None and L.state(spark, root)["version"] == 0
    assert merge(frame(spark, ("a", "x", 1, "p"), ("a", "x", 1, "q"), ("a", None, 1, "n"), ("b", "x", 5, "b"), (None, "x", 9, "lost")), root, buckets=3) == 1
    assert merge(frame(spark, ("a", "x", 1, "o"), ("a", None, 0, "old"), ("b", "y", None, "t")), root, buckets=7) == 2
    assert L.state(spark, root)["buckets"] == 3         # of the first merge
    got = {(r.domain, r.k): r.v for r in L.read(spark, root, KEYS, **HOW).collect()}
    assert got == {("a", "x"): "o", ("a", None): "n", ("b", "x"): "b", ("b", "y"): "t"}     # equal times: the later merge
    old = {(r.domain, r.k): r.v for r in L.read(spark, root, KEYS, version=1, **HOW).collect()}
    assert old == {("a", "x"): "q", ("a", None): "n", ("b", "x"): "b"}
    only = {r.domain for r in L.read(spark, root, KEYS, domains=["b"], **HOW).collect()}
    assert only == {"b"}
    merge(frame(spark, ("a", "x", 2, "new")).withColumn("more", F.lit(1)), root)            # a new column
    wide = {(r.domain, r.k): (r.v, r.more) for r in L.read(spark, root, KEYS, **HOW).collect()}
    assert wide[("a", "x")] == ("new", 1) and wide[("b", "y")] == ("t", None)


def test_a_batch_writes_only_its_own_rows(spark, tmp_out):
    root = os.path.join(tmp_out, "m")
    big = spark.range(20_000).select(F.lit("a").alias("domain"), F.col("id").cast("string").alias("k"), F.lit(1).alias("ts"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    merge(big, root, buckets=4)
    whole = size(root)
    batch = big.filter("int(k) % 500 = 0").withColumn("ts", F.lit(2))       # touches every bucket
    merge(batch, root)
    assert len(L.state(spark, root)["parts"]) == 4 and all(len(s) == 2 for s in L.state(spark, root)["parts"].values())
    assert size(root) - whole < whole / 20
    out = L.read(spark, root, KEYS, **HOW)
    assert out.count() == 20_000 and out.filter("ts = 2").count() == 40
    # Base rows without a change are not shuffled for the merge.
    before = read(spark, root)
    assert L.compact(spark, root, KEYS, **HOW) == 2                          # deltas too small
    assert L.compact(spark, root, KEYS, **HOW, max_deltas=0) == 3
    assert all(len(s) == 1 for s in L.state(spark, root)["parts"].values()) and read(spark, root) == before
    assert L.expire(spark, root, keep=1) == 8 and read(spark, root) == before and L.log_versions(spark, root) == [3]


def test_two_writers_lose_nothing(spark, tmp_out, monkeypatch):
    root = os.path.join(tmp_out, "m")
    merge(frame(spark, ("a", "x", 1, "p")), root)
    put, raced = L._put_new, []

    def slow(s, path, text):
        if not raced:                                   # another writer commits first
            raced.append(path)
            merge(frame(spark, ("a", "x", 2, "other"), ("a", "y", 1, "other")), root)
        return put(s, path, text)

    monkeypatch.setattr(L, "_put_new", slow)
    assert merge(frame(spark, ("a", "x", 3, "mine"), ("b", "z", 1, "mine")), root) == 3
    assert read(spark, root) == [("a", "x", 3, "mine"), ("a", "y", 1, "other"), ("b", "z", 1, "mine")]
    assert read(spark, root, version=2) == [("a", "x", 2, "other"), ("a", "y", 1, "other")]


def test_first_writers_race_for_an_empty_master(spark, tmp_out, monkeypatch):
    root = os.path.join(tmp_out, "m")
    put, raced = L._put_new, []

    def slow(s, path, text):
        if not raced:
            raced.append(path)
            merge(frame(spark, ("a", "x", 2, "other")), root)
        return put(s, path, text)

    monkeypatch.setattr(L, "_put_new", slow)
    merge(frame(spark, ("a", "x", 1, "mine"), ("a", "y", 1, "mine")), root)
    assert read(spark, root) == [("a", "x", 2, "other"), ("a", "y", 1, "mine")]


def test_compaction_leaves_what_came_meanwhile(spark, tmp_out, monkeypatch):
    root = os.path.join(tmp_out, "m")
    for k in range(3):
        merge(frame(spark, ("a", "x", k, f"v{k}"), ("b", "x", k, f"v{k}")), root)
    put, raced = L._put_new, []

    def slow(s, path, text):
        if not raced:
            raced.append(path)
            merge(frame(spark, ("a", "x", 9, "late")), root)
        return put(s, path, text)

    monkeypatch.setattr(L, "_put_new", slow)
    L.compact(spark, root, KEYS, **HOW, max_deltas=0)
    parts = {len(s) for s in L.state(spark, root)["parts"].values()}
    assert parts == {1, 2} and read(spark, root) == [("a", "x", 9, "late"), ("b", "x", 2, "v2")]
    # A compaction that lost against another one changes nothing.
    merge(frame(spark, ("a", "x", 10, "z")), root)
    raced.clear()
    monkeypatch.setattr(L, "_put_new", lambda s, p, t: (raced or raced.append(1) or L.compact(spark, root, KEYS, **HOW, max_deltas=0)) and put(s, p, t))
    version = L.compact(spark, root, KEYS, **HOW, max_deltas=0)
    assert version == L.state(spark, root)["version"] and read(spark, root)[0] == ("a", "x", 10, "z")


def test_a_writer_that_dies_leaves_nothing_visible(spark, tmp_out, monkeypatch):
    root = os.path.join(tmp_out, "m")
    merge(frame(spark, ("a", "x", 1, "p"), ("b", "x", 1, "p")), root)

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(L, "_put_new", dies)            # all parts are written, none is published
    try:
        merge(frame(spark, ("a", "x", 2, "q"), ("b", "x", 2, "q")), root)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert read(spark, root) == [("a", "x", 1, "p"), ("b", "x", 1, "p")]
    assert merge(frame(spark, ("a", "x", 2, "q")), root) == 2
    assert read(spark, root) == [("a", "x", 2, "q"), ("b", "x", 1, "p")]


def test_an_entry_is_created_once(spark, tmp_out):
    path = os.path.join(tmp_out, "m", "_log", "1.json")
    assert L._put_new(spark, path, "one") and not L._put_new(spark, path, "two")
    assert L._text(spark, path) == "one" and os.listdir(os.path.dirname(path)).count("1.json") == 1


def test_a_replayed_batch_changes_nothing(spark, tmp_out):
    root = os.path.join(tmp_out, "m")
    batch = frame(spark, ("a", "x", 1, "p"))
    assert merge(batch, root, stream="s", batch_id=0) == 1
    assert merge(batch, root, stream="s", batch_id=0) == 1 and merge(batch, root, stream="t", batch_id=0) == 2
    assert merge(frame(spark, ("a", "x", 2, "q")), root, stream="s", batch_id=1) == 3
    assert L.state(spark, root)["streams"] == {"s": 1, "t": 0}
    assert merge(frame(spark), root, stream="s", batch_id=2) == 4           # an empty batch is remembered too
    assert read(spark, root) == [("a", "x", 2, "q")]
