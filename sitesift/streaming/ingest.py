"""R1 + R2: landed pages into silver continuously, and first-wins dedup.

R1: ``readStream`` of landed pages -> resolve + extract + validate (all
stateless) -> ``foreachBatch`` merging each micro-batch into the versioned
master (S3/D4). The order key comes from the data (fetch time, page id,
ordinal), not from the run, so replaying a batch after a failure yields the
same master. R2: ``withWatermark`` + ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract_html import extract_html
from ..operators.quality import good_records, quality_rows
from ..operators.resolve import resolve_site
from ..operators.route import extract_records
from ..operators.validate import PENDING, soft_validate_sites
from ..sources import master_log
from ..sources.silver import merge_into_master, read_master
from ..sources.site_schema import SiteConfig

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def page_records(pages: DataFrame, configs: list[SiteConfig], mode: str = "static") -> DataFrame:
    """Stateless part shared by batch and stream: U2 -> X3/X5 -> V1."""
    resolved = resolve_site(pages, configs, url_col="url", id_col="page_id")
    recs = extract_html(resolved, configs, mode=mode)
    return soft_validate_sites(recs, configs)  # each site's own primary key


def stream_to_master(spark: SparkSession, source_dir: str, master_root: str, checkpoint: str,
                     configs: list[SiteConfig], keys: list[str], mode: str = "static",
                     schema: T.StructType = PAGES_SCHEMA, max_files: int = 1,
                     available_now: bool = True, glob: str = "pages*.parquet", buckets: int = 1):
    """Start the stream over the landed-page files of ``source_dir``:
    those matching ``glob``, and the files in folders matching it (a table
    written by Spark is a folder); returns the StreamingQuery."""
    pages = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
             .parquet(f"{source_dir.rstrip('/')}/{glob}"))
    recs = page_records(pages, configs, mode)
    pks = sorted({c.primary_key for c in configs if c.primary_key})
    pending = F.lit(False)
    for pk in pks:
        pending = pending | F.coalesce(F.col(pk) == PENDING, F.lit(False))
    # V3 per micro-batch, reported in the query progress (observedMetrics)
    recs = recs.observe("validation", F.count(F.lit(1)).alias("n_records"),
                        F.count_if(pending).alias("n_pending"))

    def merge(batch_df: DataFrame, epoch_id: int) -> None:
        # The merge reads the micro-batch twice (touched domains, then the
        # rows): keep it so pages are parsed once. A lost cached block is
        # recomputed from the source files, so executor loss is harmless.
        batch_df.persist()
        try:
            merge_into_master(batch_df.sparkSession, master_root, batch_df, keys,
                              ts_col="page_id", tiebreak=["ordinal"], buckets=buckets)
        finally:
            batch_df.unpersist()

    writer = recs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def run_to_master(spark: SparkSession, source_dir: str, master_root: str, checkpoint: str,
                  configs: list[SiteConfig], keys: list[str], mode: str = "static",
                  glob: str = "pages*.parquet") -> DataFrame:
    """R1 until the source is drained; returns the published master."""
    q = stream_to_master(spark, source_dir, master_root, checkpoint, configs, keys, mode, glob=glob)
    q.awaitTermination()
    master, _ = read_master(spark, master_root)
    return master


def stream_routed(spark: SparkSession, source_dir: str, roots: dict[str, str], checkpoint: str,
                  configs: list[SiteConfig], keys: list[str], stream: str = "routed",
                  schema: T.StructType = PAGES_SCHEMA, max_files: int = 1, buckets: int = 1):
    """R1 for every strategy, exactly once, drained (availableNow): landed
    JSON, feed and HTML pages -> three logged tables under ``roots``:
    ``master`` (records, newest page wins), ``quality`` (payloads that failed)
    and ``metrics`` (records and failures per micro-batch and site). Each
    remembers the stream's batches, so a batch that is replayed after a
    failure between them changes only what it had not changed yet. Returns
    the finished StreamingQuery."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)

    def publish(batch: DataFrame, epoch: int) -> None:
        rows = extract_records(batch, configs, quality=True).persist()       # read by three sinks
        once = {"stream": stream, "batch_id": epoch}
        try:
            good = soft_validate_sites(good_records(rows), configs)
            master_log.merge(good, roots["master"], keys, "page_id", ["ordinal"], buckets=buckets, **once)
            master_log.merge(quality_rows(rows), roots["quality"], ["domain", "page_id", "reason"], "page_id", **once)
            counts = rows.groupBy("domain").agg(F.count("ordinal").alias("n_records"), F.count("reason").alias("n_failed"))
            counts = counts.withColumn("epoch", F.lit(epoch).cast("bigint"))
            master_log.merge(counts, roots["metrics"], ["domain", "epoch"], "epoch", **once)
        finally:
            rows.unpersist()

    query = pages.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedup_stream(events: DataFrame, keys: list[str], ts_col: str, delay: str = "1 hour") -> DataFrame:
    """R2: first-wins dedup within the watermark delay. ``ts_col`` is cast to
    TIMESTAMP (a watermark on TIMESTAMP_NTZ is an analysis error)."""
    staged = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return staged.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


def rows_dropped_by_watermark(query) -> int:
    """R2: late rows dropped so far (past the watermark), summed over the
    stateful operators of the query's recent progress reports."""
    total = 0
    for progress in query.recentProgress or []:
        for op in progress.get("stateOperators", []) or []:
            total += int(op.get("numRowsDroppedByWatermark", 0) or 0)
    return total
