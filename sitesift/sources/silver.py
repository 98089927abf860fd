"""S3 + S4 + S5 + D7: the silver master, the daily sample and checkpoints.

The master is kept per domain, as the reference keeps one master per site,
and each domain is split into ``buckets`` parts by a hash of the dedup key;
every part is versioned on its own::

    <root>/d=<md5(domain)[:16]>/b=<bucket>/v=<n>/part-*.parquet  (+ _SUCCESS)

A merge reads and rewrites only the parts its batch touches: a small
incremental batch into a large master rewrites a few buckets, not the whole
site, and a site holding a third of the data is never rewritten whole for a
handful of new records. The touched list is bounded by configuration (sites
times buckets), not by the data. Merged rows are written once into a staging
folder, partitioned by part, and each part's folder is renamed into place as
that part's next version and committed. Readers take each part's newest
committed, readable version. Spark never overwrites a path it is reading; a
failed writer leaves only uncommitted folders; an unreadable version is
skipped and reported (D7) instead of being renamed away. The bucket count is
fixed when a master is created (``_layout.json``).
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import materialize
from ..operators.merge import dedup_first, merge_history

PROVENANCE = ("scraped_at", "silver_processed_at")
LAYOUT = "_layout.json"
_VERSION = re.compile(r"^v=(\d+)$")
_DOMAIN = re.compile(r"^d=([0-9a-f]{16})$")
_BUCKET = re.compile(r"^b=(\d+)$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def domain_dir(domain: str) -> str:
    import hashlib
    return "d=" + hashlib.md5(domain.encode("utf-8")).hexdigest()[:16]


def part_dir(domain: str, bucket: int) -> str:
    return f"{domain_dir(domain)}/b={bucket}"


def layout_buckets(spark: SparkSession, root: str, requested: int | None = None) -> int:
    """The master's bucket count: from its layout file, else ``requested``
    (written as the layout when the master is created)."""
    fs, _, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{LAYOUT}")
    if fs.exists(path):
        stream = fs.open(path)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(json.loads(text)["buckets"])
    n = int(requested or 1)
    out = fs.create(path, True)
    out.write(bytearray(json.dumps({"buckets": n}).encode()))
    out.close()
    return n


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The part a row belongs to: a hash of its dedup key."""
    if buckets <= 1:
        return F.lit(0)
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> dict[str, list[tuple[int, bool]]]:
    """Per part (``d=<digest>/b=<bucket>``): (version, committed), oldest first."""
    fs, p, jvm = _fs(spark, root)
    out: dict[str, list[tuple[int, bool]]] = {}
    if not fs.exists(p):
        return out
    for dst in fs.listStatus(p):
        if not (dst.isDirectory() and _DOMAIN.match(dst.getPath().getName())):
            continue
        for bst in fs.listStatus(dst.getPath()):
            if not (bst.isDirectory() and _BUCKET.match(bst.getPath().getName())):
                continue
            vs = []
            for st in fs.listStatus(bst.getPath()):
                m = _VERSION.match(st.getPath().getName())
                if st.isDirectory() and m:
                    ok = fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
                    vs.append((int(m.group(1)), bool(ok)))
            out[f"{dst.getPath().getName()}/{bst.getPath().getName()}"] = sorted(vs)
    return out


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018 - reads the footers
        return True
    except Exception as e:
        # a damaged file only; a passing storage error must not bring older data back
        if re.search(r"footer|not a Parquet|UNABLE_TO_INFER_SCHEMA", str(e), re.IGNORECASE):
            return False
        raise


def read_master(spark: SparkSession, root: str, domains: list[str] | None = None,
                parts: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """The newest readable committed version of every part (or of the parts
    of ``domains``, or of the given ``parts``) as one DataFrame, and the
    problems met (D7)."""
    root = root.rstrip("/")
    wanted_d = None if domains is None else {domain_dir(d) for d in domains}
    wanted_p = None if parts is None else set(parts)
    problems: list[str] = []
    paths: list[str] = []
    for pdir, vs in sorted(versions(spark, root).items()):
        if wanted_d is not None and pdir.split("/")[0] not in wanted_d:
            continue
        if wanted_p is not None and pdir not in wanted_p:
            continue
        for v, ok in reversed(vs):
            path = f"{root}/{pdir}/v={v}"
            if not ok:
                problems.append(f"{pdir}/v={v}: not committed, skipped")
            elif not _readable(spark, path):
                problems.append(f"{pdir}/v={v}: unreadable, kept aside")
            else:
                paths.append(path)
                break
    if not paths:
        return None, problems
    # sites differ in their columns: the schema is the union over the parts
    return spark.read.option("mergeSchema", "true").parquet(*paths), problems


def merge_into_master(spark: SparkSession, root: str, batch: DataFrame, keys: list[str],
                      ts_col: str = "scraped_at", tiebreak: list[str] = (),
                      domain_col: str = "domain", domains: list[str] | None = None,
                      buckets: int = 1) -> tuple[dict[str, int], list[str]]:
    """S3 + D4: merge ``batch`` into the master; only the touched parts are
    read and rewritten. Returns {part: new version} (the part is the domain
    itself when the master has one bucket) and the problems met.

    ``domains``: the batch's domains when the caller knows them cheaply (a
    superset is fine; used with one bucket); otherwise the touched parts are
    read from the batch (at most sites x buckets rows), which evaluates it
    once more - persist it then. ``buckets`` applies when the master is new.
    """
    root = root.rstrip("/")
    n_buckets = layout_buckets(spark, root, buckets)
    hash_keys = [k for k in keys if k != domain_col] or keys
    staged = batch.withColumn("_b", bucket_of(hash_keys, n_buckets))
    if n_buckets == 1 and domains is not None:
        touched = [(d, 0) for d in domains if d is not None]
    else:
        touched = [(r[0], r[1]) for r in staged.select(domain_col, "_b").distinct().collect()
                   if r[0] is not None]
    if not touched:
        return {}, []
    names = {part_dir(d, b): (d, b) for d, b in touched}
    history, problems = read_master(spark, root, parts=list(names))
    if history is not None:
        history = history.withColumn("_b", bucket_of(hash_keys, n_buckets))
    merged = merge_history(history, staged, keys, ts_col, tiebreak)
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    (merged.withColumn("_d", F.substring(F.md5(F.col(domain_col)), 1, 16))
           .write.partitionBy("_d", "_b").parquet(stage))
    fs, _, jvm = _fs(spark, root)
    known = versions(spark, root)
    published = {}
    for pdir, (d, b) in names.items():
        src = jvm.org.apache.hadoop.fs.Path(f"{stage}/_d={domain_dir(d)[2:]}/_b={b}")
        if not fs.exists(src):
            continue
        nxt = max((v for v, _ in known.get(pdir, [])), default=0) + 1
        dst = jvm.org.apache.hadoop.fs.Path(f"{root}/{pdir}/v={nxt}")
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise RuntimeError(f"could not publish {dst} (concurrent writer?)")
        fs.create(jvm.org.apache.hadoop.fs.Path(dst, "_SUCCESS"), False).close()
        published[d if n_buckets == 1 else pdir] = nxt
    fs.delete(jvm.org.apache.hadoop.fs.Path(stage), True)
    return published, problems


def sample_frame(df: DataFrame, snapshot_date) -> DataFrame:
    """The daily sample rows: provenance columns dropped, day stamped."""
    day = snapshot_date if not isinstance(snapshot_date, str) else F.lit(snapshot_date).cast("date")
    return df.drop(*[c for c in PROVENANCE if c in df.columns]).withColumn("snapshot_date", day)


def write_sample(df: DataFrame, path: str, snapshot_date) -> None:
    """S4 sink: CSV with header, one folder per domain and day; only the
    day's partitions are replaced."""
    out = sample_frame(df, snapshot_date)
    parts = [c for c in ("domain", "snapshot_date") if c in out.columns]
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts).option("header", True).csv(path))


def merge_sample(batch: DataFrame, path: str, snapshot_date, domains: list[str], ts_col: str,
                 tiebreak: list[str] = ()) -> None:
    """S4 + D5: merge a keyed batch (``dedup_key``) into the sample of its day
    and write that sample. Earlier rows of the day carry no timestamp and rank
    below the batch. What a day holds is kept in Parquet under ``_state``
    (CSV files of different runs need not have the same columns); the CSV
    folders are written from it."""
    spark = batch.sparkSession
    state = f"{path.rstrip('/')}/_state"
    day = snapshot_date if not isinstance(snapshot_date, str) else F.lit(snapshot_date).cast("date")
    new = batch.drop("silver_processed_at").withColumn("snapshot_date", day)
    fs, p, _ = _fs(spark, state)
    earlier = None
    if fs.exists(p):
        days = [r[0] for r in new.select("snapshot_date").distinct().collect()]  # the days of one batch
        earlier = (spark.read.option("mergeSchema", "true").parquet(state)
                   .filter(F.col("domain").isin(*domains) & F.col("snapshot_date").isin(*days)))
        earlier = earlier.withColumn(ts_col, F.lit(None).cast(dict(new.dtypes)[ts_col]))
    merged = materialize(merge_history(earlier, new, ["domain", "snapshot_date", "dedup_key"], ts_col, tiebreak)
                         .drop(*PROVENANCE, ts_col))
    parts = ["domain", "snapshot_date"]
    whole = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    whole.parquet(state)
    rows = merged.drop("dedup_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy(*parts).option("header", True).csv(path)


def save_checkpoint(records: DataFrame, path: str, arrival: list[str]) -> DataFrame:
    """First-wins dedup of what has accumulated, overwritten in place of
    the previous checkpoint; returns the re-read checkpoint so later steps
    start from the written table, not the lineage. The new one is written
    beside the old and takes its place when whole."""
    spark = records.sparkSession
    fs, p, jvm = _fs(spark, path)
    side = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}")
    dedup_first(records, arrival).write.parquet(side.toString())
    if fs.exists(p):
        fs.delete(p, True)
    if not fs.rename(side, p):
        raise RuntimeError(f"could not publish {path}")
    return spark.read.parquet(path)


def remove_checkpoint(spark: SparkSession, path: str) -> None:
    """The checkpoint goes once its run has succeeded."""
    fs, p, _ = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
