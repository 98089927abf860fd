"""S1 + S2: the raw ("bronze") layer of landed pages.

``raw_pages(url, netloc, fetch_date, fetched_at, url_hash, format, body)``
partitioned by ``netloc`` and ``fetch_date``, written append-only
*before* parsing, so a fixed parser can re-read it without fetching again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import cache_key, netloc, url_hash

RAW_COLUMNS = ["url", "netloc", "fetch_date", "fetched_at", "url_hash", "format", "body"]
# <netloc>/<YYYY-MM-DD>/<16 hex hash>_<HHMMSS>.<ext>
RAW_FILE = r"([^/]+)/(\d{4}-\d{2}-\d{2})/([0-9a-f]{16})_(\d{6})\.(\w+)$"


def payload_format(body: Column) -> Column:
    """A label for readers, over the whole payload: ``json`` when the body, after
    any white space, starts like JSON, ``rss`` when it holds an
    ``<rss``/``<feed`` element, else ``html``."""
    head = F.regexp_replace(F.coalesce(body, F.lit("")), r"^[\s\x{feff}]+", "")
    return (F.when(head.startswith("{") | head.startswith("["), F.lit("json"))
            .when(F.lower(body).rlike("<(rss|feed)[\\s>]"), F.lit("rss"))
            .otherwise(F.lit("html")))


def landed_to_raw(pages: DataFrame, fetched_at: Column, url_col: str = "url",
                  body_col: str = "html", strip: bool | Column = True) -> DataFrame:
    """Landed pages (url, body) -> the raw-layer schema. ``fetched_at``
    keeps its type (TIMESTAMP_NTZ stays zone-free)."""
    ts = fetched_at
    return pages.select(
        F.col(url_col).alias("url"),
        netloc(F.col(url_col)).alias("netloc"),
        F.to_date(ts).alias("fetch_date"),
        ts.alias("fetched_at"),
        url_hash(cache_key(F.col(url_col), strip)).alias("url_hash"),
        payload_format(F.col(body_col)).alias("format"),
        F.col(body_col).alias("body"),
    )


def read_raw_files(spark: SparkSession, root: str) -> DataFrame:
    """S1 for a cache laid out as files: one row per file, the netloc, day,
    hash and time parsed out of the path (``_metadata.file_path``)."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, RAW_FILE, i)
    ts = F.to_timestamp(F.concat_ws(" ", part(2), part(4)), "yyyy-MM-dd HHmmss")
    return df.select(
        F.lit(None).cast("string").alias("url"),
        part(1).alias("netloc"),
        F.to_date(part(2)).alias("fetch_date"),
        ts.alias("fetched_at"),
        part(3).alias("url_hash"),
        F.when(part(5) == "json", F.lit("json")).otherwise(payload_format(F.col("value"))).alias("format"),
        F.col("value").alias("body"),
    )


def write_raw(raw: DataFrame, path: str) -> None:
    """Append-only, partitioned by payload format, netloc and fetch day.
    Rows are brought together by site and day first, so a task writes few
    files; a day of one site that is too large for a task is split by AQE."""
    rows = raw.select(*RAW_COLUMNS).hint("rebalance", "netloc", "fetch_date")
    rows.write.mode("append").partitionBy("format", "netloc", "fetch_date").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """S1 over the written raw layer (partition filters prune directories)."""
    return spark.read.parquet(path)
