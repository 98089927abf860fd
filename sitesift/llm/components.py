"""Connected components of an edge table, as joins on Spark: every node hooks
to its smallest neighbour, hooks are followed to their ends, and a further
round sees only the edges between different ends. Rounds are written to the
shared folder; only whether something is left reaches the driver. Star-shaped
edges need one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import written


def _hooked(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges`` with the end of its hooks, the
    smallest node of what hangs together by them."""
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    near = edges.select(F.explode(both).alias("e")).select("e.*").groupBy("node").agg(F.min("near").alias("near"))
    step = written(near.select("node", F.least("node", "near").alias("label")), "cc")
    while True:
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = written(step.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("moved")), "cc-step")
        step = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return step


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node in ``edges(a, b)``; label is the smallest
    node of the component."""
    left = written(edges.select("a", "b"), "cc-edges")
    labels = step = _hooked(left)
    while True:
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")) for c in ("a", "b")]
        left = left.join(ends[0], "a").join(ends[1], "b").filter("a2 <> b2")
        left = written(left.select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "cc-left")
        if left.isEmpty():
            return labels
        step = _hooked(left)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")
