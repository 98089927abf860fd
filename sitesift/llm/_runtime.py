"""Shared-folder tables and worker code for the operators of this package."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, ship_package


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: evaluates it once
    and cuts its lineage; the files survive a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is popular if more than one row in so many has it: at most POPULAR keys are.
POPULAR = 1000


def join_popular(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key) on ``keys``, without a
    hot key in one task: the rows that ``right`` marks as ``popular``, at most
    POPULAR, are broadcast; the others are joined by a shuffle."""
    popular = right.filter("popular").drop("popular")
    met = left.join(F.broadcast(popular), keys)
    rest = left.join(F.broadcast(popular.select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(right.filter("NOT popular").drop("popular"), keys, how))


def running_sums(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], name: str) -> DataFrame:
    """``df`` with running sums of ``values`` (by the names of their columns)
    within ``by`` in ``order`` (with ties in any order), without a group in one
    task: sums inside the partitions of a range sort, plus the totals of the
    partitions before (a row per group and partition)."""
    own = {f"_own_{c}": v for c, v in values.items()}
    salted = df.withColumns({"_row": F.monotonically_increasing_id(), **own})
    ranged = written(salted.repartitionByRange(*by, *order, "_row").withColumn("_part", F.spark_partition_id()), name)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(*[F.sum(f"_own_{c}").alias(f"_sum_{c}") for c in values])
    parts = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in values])
    inside = Window.partitionBy(*by, "_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({f"_in_{c}": F.sum(f"_own_{c}").over(inside) for c in values}).join(parts, [*by, "_part"])
    rows = rows.withColumns({c: F.col(f"_in_{c}") + F.col(f"_before_{c}") for c in values})
    return rows.drop("_part", "_row", *[f"{x}_{c}" for c in values for x in ("_own", "_in", "_before")])


def shipped(fn: Callable) -> Callable:
    """The query with this package importable in the Python workers."""
    @functools.wraps(fn)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return fn(spark, *args)
    return run
