"""S3 + D4 with a commit log: snapshots, merge-on-read and compaction.

    <root>/_log/<version>.json     which folders make up the master
    <root>/data/<id>/_d=../_b=../  rows of one merge or compaction, by part

A merge writes only its own rows (newest per key), a folder for each (domain,
bucket) part that it touches, and publishes all of them at once by creating the
next log entry, which must not exist yet. Who loses that race reads the new
state and tries again with the same rows: merges only add to a part, so they
never conflict. A reader takes one entry and sees all of a merge or nothing of
it; folders that no entry names (a writer that died) are never read. An entry
also carries the last batch of every stream, so that a replayed batch is seen
and changes nothing.

A part is one base and later deltas. Reading it keeps the newest row of each
key, as D3 and D4 do: greatest time, then the later merge, then the tiebreak.
Base rows whose key is in no delta are passed on as they are; parts without
deltas are read straight. :func:`compact` writes a new base for parts whose
deltas have grown, and leaves parts alone that another compaction has changed
meanwhile. Older entries stay readable until :func:`expire` drops them.

An entry holds a few numbers a folder: sites times buckets times ``MAX_DELTAS``
at most once compacted, whatever the number of rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import dedup_newest
from .silver import _fs, bucket_of, part_dir

#: A part is compacted above that many deltas, or deltas of that share of its base.
MAX_DELTAS = 8
DELTA_SHARE = 0.3
EMPTY = {"version": 0, "buckets": None, "streams": {}, "parts": {}}


def _entry(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_log/{version:020d}.json"


def _text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` whole, unless it exists: one atomic step. A local file
    system renames over an existing file, so there a hard link is made."""
    fs, p, jvm = _fs(spark, path)
    side = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(side, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(side.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return bool(not fs.exists(p) and fs.rename(side, p))
    finally:
        fs.delete(side, False)


def log_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p, _ = _fs(spark, f"{root.rstrip('/')}/_log")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The log entry of ``version`` (default: the newest)."""
    known = log_versions(spark, root)
    if version is None:
        version = known[-1] if known else 0
    elif version and version not in known:
        raise ValueError(f"version {version} of {root}: not in the log")
    return json.loads(_text(spark, _entry(root, version))) if version else json.loads(json.dumps(EMPTY))


def _commit(spark: SparkSession, root: str, change: Callable[[dict], dict | None]) -> int:
    """Publish what ``change`` makes of the newest state (None: nothing to
    do), again and again until no other writer was faster."""
    while True:
        old = state(spark, root)
        new = change(old)
        if new is None:
            return old["version"]
        new["version"] = old["version"] + 1
        if _put_new(spark, _entry(root, new["version"]), json.dumps(new, sort_keys=True)):
            return new["version"]


def _write(rows: DataFrame, root: str, domain_col: str) -> dict[str, dict]:
    """Rows with ``_b`` written by part: {part: path, rows, bytes}."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    folder = f"{root.rstrip('/')}/{name}"
    rows.withColumn("_d", F.substring(F.md5(F.col(domain_col)), 1, 16)).write.partitionBy("_d", "_b").parquet(folder)
    fs, p, _ = _fs(spark, folder)
    if not any(s.isDirectory() for s in fs.listStatus(p)):
        return {}
    counts = spark.read.parquet(folder).groupBy(F.col("_d").cast("string"), "_b").agg(F.count(F.lit(1)).alias("n")).collect()  # parts
    out = {}
    for r in counts:
        path = f"{name}/_d={r['_d']}/_b={r['_b']}"
        size = fs.getContentSummary(_fs(spark, f"{root.rstrip('/')}/{path}")[1]).getLength()
        out[f"d={r['_d']}/b={r['_b']}"] = {"path": path, "rows": r["n"], "bytes": int(size)}
    return out


def merge(batch: DataFrame, root: str, keys: list[str], ts_col: str = "scraped_at", tiebreak: list[str] = (),
          domain_col: str = "domain", buckets: int = 1, stream: str | None = None, batch_id: int | None = None) -> int:
    """Merge ``batch`` into the master and return the version that holds it.
    Rows without a domain are left out, as a master is kept per domain.
    ``buckets`` counts when the master is new. With ``stream`` and
    ``batch_id`` a batch that the log already holds changes nothing."""
    spark = batch.sparkSession
    seen = lambda s: stream is not None and s["streams"].get(stream, -1) >= batch_id
    now = state(spark, root)
    if seen(now):
        return now["version"]
    n = now["buckets"] or buckets
    hashed = [k for k in keys if k != domain_col] or keys
    rows = dedup_newest(batch.filter(F.col(domain_col).isNotNull()), keys, ts_col, list(tiebreak))
    made = _write(rows.withColumn("_b", bucket_of(hashed, n)), root, domain_col)

    def add(old: dict) -> dict | None:
        if seen(old):
            return None
        if (old["buckets"] or n) != n:
            raise RuntimeError(f"{root} was made with {old['buckets']} buckets meanwhile")
        for part, segment in made.items():
            old["parts"].setdefault(part, []).append({**segment, "seq": old["version"] + 1})
        if stream is not None:
            old["streams"][stream] = batch_id
        return {**old, "buckets": n}

    return _commit(spark, root, add)


def _segments(spark: SparkSession, root: str, segments: list[dict]) -> DataFrame | None:
    """The rows of segments, with the merge they came by as ``_seq``."""
    out = None
    for seq in sorted({s["seq"] for s in segments}):
        paths = [f"{root.rstrip('/')}/{s['path']}" for s in segments if s["seq"] == seq]
        rows = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("_seq", F.lit(seq))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _merged(spark: SparkSession, root: str, parts: dict[str, list[dict]], keys: list[str], ts_col: str,
            tiebreak: list[str]) -> DataFrame | None:
    still = _segments(spark, root, [s[0] for s in parts.values() if len(s) == 1])
    base = _segments(spark, root, [s[0] for s in parts.values() if len(s) > 1])
    if base is None:
        return still
    delta = _segments(spark, root, [x for s in parts.values() for x in s[1:]])
    changed = delta.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    newest = dedup_newest(base.join(changed, same, "left_semi").unionByName(delta, allowMissingColumns=True),
                          keys, ts_col, ["_seq", *tiebreak])
    out = base.join(changed, same, "left_anti").unionByName(newest, allowMissingColumns=True)
    return out if still is None else out.unionByName(still, allowMissingColumns=True)


def read(spark: SparkSession, root: str, keys: list[str], ts_col: str = "scraped_at", tiebreak: list[str] = (),
         version: int | None = None, domains: list[str] | None = None) -> DataFrame | None:
    """The master as one log entry has it: the newest row of each key. Only
    the parts of ``domains`` are read where they are given. None: no rows."""
    now = state(spark, root, version)
    parts = now["parts"]
    if domains is not None:
        wanted = {part_dir(d, b) for d in domains for b in range(now["buckets"] or 1)}
        parts = {p: s for p, s in parts.items() if p in wanted}
    out = _merged(spark, root, parts, keys, ts_col, list(tiebreak))
    return None if out is None else out.drop("_seq")


def compact(spark: SparkSession, root: str, keys: list[str], ts_col: str = "scraped_at", tiebreak: list[str] = (),
            domain_col: str = "domain", max_deltas: int = MAX_DELTAS, share: float = DELTA_SHARE) -> int:
    """One base for every part with more than ``max_deltas`` deltas, or whose
    deltas come to more than ``share`` of its base; returns the version."""
    now = state(spark, root)
    grown = {p: s for p, s in now["parts"].items()
             if len(s) > 1 and (len(s) - 1 > max_deltas or sum(x["bytes"] for x in s[1:]) > share * s[0]["bytes"])}
    if not grown:
        return now["version"]
    hashed = [k for k in keys if k != domain_col] or keys
    rows = _merged(spark, root, grown, keys, ts_col, list(tiebreak)).drop("_seq")
    made = _write(rows.withColumn("_b", bucket_of(hashed, now["buckets"])), root, domain_col)

    def replace(old: dict) -> dict | None:
        done = False
        for part, segment in made.items():
            read_, there = grown[part], old["parts"].get(part, [])
            if [s["path"] for s in there[:len(read_)]] == [s["path"] for s in read_]:
                old["parts"][part] = [{**segment, "seq": read_[-1]["seq"]}, *there[len(read_):]]
                done = True
        return old if done else None

    return _commit(spark, root, replace)


def expire(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Drop all but the newest ``keep`` entries and the folders that only they
    name; returns how many folders went. Folders that no entry ever named
    (perhaps of a writer at work) stay."""
    known = log_versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    paths = lambda v: {s["path"] for part in state(spark, root, v)["parts"].values() for s in part}
    gone = set().union(*map(paths, old)) - set().union(*map(paths, kept))
    for v in old:
        fs, p, _ = _fs(spark, _entry(root, v))
        fs.delete(p, False)
    for path in gone:
        fs, p, _ = _fs(spark, f"{root.rstrip('/')}/{path}")
        fs.delete(p, True)
    return len(gone)
