"""Dedup keys, first-wins and newest-wins dedup, merge with history.

Dedup is a grouped ``min_by`` / ``max_by`` over a struct of the whole row:
a hash aggregate with map-side partial aggregation, so a key that holds a
third of all rows is reduced to one row per map task before the shuffle
(a ``row_number`` window would sort the whole hot key in one task).
Ties are broken by an explicit order key, never by arrival luck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIRST_WINS_KEYS, TITLE_KEYS  # fixed values
from ..functions.text import money_history
from ..functions.urls import strip_query


def choose_dedup_keys(columns: list[str], schema_keys: list[str] | tuple = ()) -> list[str]:
    """D1 (driver side, from the schema, never from rows)."""
    if schema_keys:
        keys = [k for k in schema_keys if k in columns]
    else:
        title = next((t for t in TITLE_KEYS if t in columns), None)
        keys = ["source_url", title] if title else ["source_url"]
    return [k for k in keys if k in columns]


def _pick(df: DataFrame, keys: list[str], order: list[Column], newest: bool) -> DataFrame:
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*order)
    agg = F.max_by(row, rank) if newest else F.min_by(row, rank)
    picked = df.groupBy(*[F.col(k) for k in keys]).agg(agg.alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) for c in cols])


def dedup_first(df: DataFrame, arrival: list[str], keys: list[str] | None = None) -> DataFrame:
    """Keep the earliest arrival per key (keys default to whichever of
    title, job_title, company, link, source_url exist)."""
    keys = keys if keys is not None else [k for k in FIRST_WINS_KEYS if k in df.columns]
    if not keys:
        return df
    return _pick(df, keys, [F.col(c) for c in arrival], newest=False)


def dedup_newest(df: DataFrame, keys: list[str], ts_col: str = "scraped_at",
                 tiebreak: list[str] = ()) -> DataFrame:
    """D3: newest ``ts_col`` per key; a missing timestamp ranks last; further
    ties go to the larger ``tiebreak`` values (e.g. batch, then ordinal)."""
    if not keys:
        return df
    order = [F.col(ts_col)] + [F.col(c) for c in tiebreak]
    return _pick(df, keys, order, newest=True)


def merge_history(history: DataFrame | None, batch: DataFrame, keys: list[str],
                  ts_col: str = "scraped_at", tiebreak: list[str] = ()) -> DataFrame:
    """History and the new batch, columns matched by name (missing ones
    NULL), then newest-wins. The batch outranks history on equal timestamps;
    ``_batch`` stays in the output so a re-run of the same batch is a no-op."""
    new = batch.withColumn("_batch", F.lit(1))
    if history is None:
        combined = new
    else:
        hist = history.withColumn("_batch", F.lit(0)) if "_batch" not in history.columns else history
        combined = hist.unionByName(new, allowMissingColumns=True)
    return dedup_newest(combined, keys, ts_col, ["_batch", *tiebreak]).drop("_batch")


def reclean_snapshot(snapshot: DataFrame, strip: bool | None, money_col: str | None) -> DataFrame:
    """D5 prologue: the day's sample is cleaned again (U3, a plain
    numeric parse of the money column) before merging."""
    out = snapshot
    if "source_url" in out.columns:
        out = out.withColumn("source_url", strip_query("source_url", bool(strip)))
    if money_col and money_col in out.columns:
        out = out.withColumn(money_col, money_history(money_col))
    return out


def snapshot_merge(snapshot: DataFrame, batch: DataFrame, keys: list[str], strip: bool | None = False,
                   money_col: str | None = None, ts_col: str = "scraped_at",
                   tiebreak: list[str] = ()) -> DataFrame:
    """Merge the batch into the same-day sample. The sample has no
    timestamp column, so its rows rank below every stamped new row."""
    snap = reclean_snapshot(snapshot, strip, money_col)
    return merge_history(snap, batch, keys, ts_col, tiebreak)


def silver_stamp(df: DataFrame, run_ts) -> DataFrame:
    """The run's timestamp, passed in (not ``current_timestamp()``) so a
    replay produces the same table."""
    ts = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    return df.withColumn("silver_processed_at", ts)
