"""Mixing sources to target weights by Pareto order sampling, in DataFrame
operations only.

Targets. Every source gets words by its weight; none more than ``most`` times
its size, and what is over goes to the others by weight until none is above.
The sources are numbered by code point (null last) and carry the weights in
turn.

Copies. A source whose target is f times its size takes every document
floor(f) times: these whole copies are certain. What is left is a sample: each
document with inclusion odds p / (1 - p), p = f - floor(f), is ranked by its
random odds u / (1 - u) over its inclusion odds, and the first in that order
are taken: as many as fit into the words that are left. The size that is fixed
is thus the number of words. At the end the last place, or the last up to
BACK + 1 of them, go to the one document whose size fits best the words that
then lack, if that comes nearer: a source ends within about the spacing of its
sizes of its target. u is a hash of the seed, the doc_id and the text: reruns
agree, whatever the partitioning.

Scale. One pass over the texts leaves four numbers a document. The order is
made by a range sort over (source, rank), so that a source that holds a third
of all documents is spread over the tasks; running sums are those inside a
partition plus the totals of the partitions before (a row per source and
partition). Sources are numbered in the same way. Tables of a row per source
are broadcast up to 100,000 sources, counted first; beyond that they are
joined by a shuffle. Nothing is collected but two sums a round of the
resharing.

Defined cases: a null or empty text has size 0 and takes 0 words. A source
without words has target 0. Repeated rows are documents of their own, with the
same rank; which of them is taken makes no difference to the result. A null
doc_id counts as '' in the hash. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ._runtime import written

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents at the end of a source's sample that may go for one that fits.
BACK = 8
#: Hex digits of the hash that make u: 52 bits.
DIGITS = 13


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` within ``by`` in ``order``
    (with ties in any order), without a group in one task."""
    salted = df.withColumns({"_row": F.monotonically_increasing_id(), "_value": value})
    ranged = written(salted.repartitionByRange(*by, *order, "_row").withColumn("_part", F.spark_partition_id()), "mix-order")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("_inside", F.sum("_value").over(inside)).join(parts, [*by, "_part"])
    return rows.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part", "_value", "_row")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``sid``, the number of the source, its
    ``target`` and the whole ``copies`` and the share ``p`` that it comes to."""
    order = F.struct(F.col("source").isNull(), F.col("source"))
    rows = running(sources.withColumn("_o", order), [], ["_o"], F.lit(1), "sid").drop("_o")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(rows.withColumn("weight", turn.cast("bigint")), "mix-sources")
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")
    top = F.lit(most) * F.col("source_size")
    words = rows.agg(F.sum("source_size")).first()[0] or 0
    weight = rows.agg(F.sum("weight")).first()[0] or 0
    full, left, shared = F.lit(False), words, weight
    while shared:
        above = full | (wide(top) * wide(shared) < wide(F.col("weight")) * wide(left))
        got = rows.agg(F.sum(F.when(above, top)).alias("top"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        now = (words - (got["top"] or 0), got["free"] or 0)
        if now == (left, shared):
            break
        full, (left, shared) = above, now
    target = F.when(full, top.cast("double")).otherwise((F.col("weight") * left).cast("double") / F.lit(float(shared or 1)))
    rows = rows.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("copies", F.floor(times)).withColumn("p", times - F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and copies of every
    row of ``docs(doc_id, text, source)``."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit(f"{seed} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text)
    digits = F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("bigint")
    u = (digits.cast("double") + 0.5) / float(16 ** DIGITS)
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), u.alias("u"))
    rows = written(rows, "mix-rows")
    goals = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    of = goals.withColumnRenamed("source", "_source")
    rows = join_small(rows, of, F.col("source").eqNullSafe(F.col("_source")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    in_play = (F.col("p") > 0) & (F.col("size") > 0)
    rows = rows.select("doc_id", "size", "source_size", "target", "copies", "sid", F.when(in_play, odds).alias("q"),
                       (F.col("target") - F.col("copies") * F.col("source_size")).alias("need"))
    drawn = running(rows.withColumn("_o", F.struct(F.col("q").isNull().alias("n"), "q", "doc_id", "size")), ["sid"], ["_o"],
                    F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0), "upto")
    drawn = written(drawn.withColumns({"taken_once": F.col("q").isNotNull() & (F.col("upto") <= F.col("need")),
                                       "place": F.monotonically_increasing_id()}), "mix-drawn")
    # What lacks after the first documents in order, less the last 0 to BACK of them.
    latest = Window.partitionBy("sid").orderBy(F.desc("upto"), F.desc("_o"))
    ends = drawn.filter("taken_once").withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= BACK + 1)
    ends = ends.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("k", "upto"))).alias("ends"))
    goals = goals.select("sid", (F.col("target") - F.col("copies") * F.col("source_size")).alias("need")).join(ends, "sid", "left")
    uptos = F.concat(F.coalesce("ends.upto", F.array().cast("array<bigint>")), F.array(F.lit(0)))
    gaps = goals.select("sid", F.transform(F.slice(uptos, 1, BACK + 1), lambda x: F.col("need") - x).alias("gaps"))
    fits = F.array_min(F.transform("gaps", lambda g, k: F.struct(F.abs(F.col("size") - g).alias("off"), k.alias("k"))))
    rest = drawn.filter(F.col("q").isNotNull() & ~F.col("taken_once"))
    rest = join_small(rest, gaps, "sid").withColumn("fits", fits)
    last = rest.filter(F.col("fits.off") < F.get("gaps", F.lit(0))).groupBy("sid").agg(F.min_by(
        F.struct("place", (F.col("need") - F.get("gaps", F.col("fits.k"))).alias("upto")), F.struct("fits", "_o", "place")).alias("last"))
    rows = join_small(drawn, last, "sid", "left")
    once = (F.col("taken_once") & (F.col("last").isNull() | (F.col("upto") <= F.col("last.upto") + 0.5))) \
        | F.coalesce(F.col("place") == F.col("last.place"), F.lit(False))
    return rows.withColumn("copies", F.col("copies") + once.cast("bigint")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
