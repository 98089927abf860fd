"""Joining a derived, usually small table back onto a large one.

A table derived from the data (group statistics, per-site stop pages) has a
size that grows with the number of groups, so it is broadcast only after a
bounded count proves it small; otherwise it is an ordinary shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path

BROADCAST_ROWS = 100_000


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a reliable ``checkpoint()``
    into the shared folder named by ``spark.checkpoint.dir`` (it survives
    the loss of any executor, unlike a local checkpoint)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """As :func:`materialize`, for many rows: written as Parquet (compressed,
    by column, a folder per value of ``by``) into the shared folder and read
    back."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``big.join(small)`` for a ``small`` side derived from the data.

    ``small`` is materialised once (checkpoint), its row count read from the
    checkpoint, and it is broadcast only when it has at most ``max_rows``
    rows; otherwise both sides are shuffled on the key. The big side is never
    shuffled just to meet a side that turns out to be tiny (which is what
    leaving the choice to AQE at runtime can cost), and the derivation of
    ``small`` is not run twice."""
    small = materialize(small)
    n = small.count()
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on, how)


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """``df`` with a dense number from 0 for every row, in any order: the
    place within the partition plus the rows of the partitions before (a row
    per partition is all that meets in one task). Materialised, so that the
    numbers stay what they are."""
    mid = F.monotonically_increasing_id()
    rows = materialize(df.withColumns({"_part": F.shiftright(mid, 33), "_place": mid.bitwiseAND((1 << 33) - 1)}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return join_small(rows, parts, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def spread(scan: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a freshly read table over the task slots when the scan makes
    fewer partitions than that (a small single-row-group file is one task),
    so CPU-heavy stages after it (HTML parsing, JSON, tokenising) use every
    core. A no-op for large tables, which scan into many partitions, so big
    inputs are never reshuffled for nothing.

    Call it on a scan (plus projections/filters) only: there the partition
    count is known at planning time. After a shuffle AQE already keeps at
    least the default parallelism (``coalescePartitions.parallelismFirst``).
    """
    try:
        want = min_partitions or scan.sparkSession.sparkContext.defaultParallelism
        have = scan.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a Spark Connect session): leave as is
        return scan
    return scan if have >= want else scan.repartition(want)
