"""C1-C5 + U7: crawl planning as table operators.

* U7 ``page_frontier``: page numbers per target via ``explode(sequence)``.
* C1 ``limit_per_site``: ``row_number() <= n`` per site in page order; Spark
  plans it with a partial ``WindowGroupLimit``, so at most ``n`` rows per
  site leave each map task.
* C2 ``url_cap``: global ``orderBy().limit()`` (per-task top-k, then merge).
* C3 ``crawl_halt``: stop after ``max_empty`` consecutive empty pages, found
  without a per-site window: every empty page votes for the ``max_empty``
  page numbers it could end a run at; a page number with ``max_empty`` votes
  ends a run of empties. Both steps are partial aggregates, so a site with a
  third of all pages is still spread over every task.
* C4 ``fresh_cache``: newest copy per URL hash, younger than the TTL.
* C5 ``to_fetch``: frontier minus fresh cache (left anti join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CACHE_TTL_HOURS, MAX_EMPTY, URL_CAP  # fixed values
from ..functions.urls import cache_key, page_url, url_hash
from ..operators.joins import join_small


def page_frontier(targets: DataFrame, n_pages: int | Column, url_col: str = "url",
                  start_page: int | Column = 1, pattern: str | Column | None = None,
                  param: str | Column = "page") -> DataFrame:
    """One row per (target, page number) from ``start_page``; page <= 1
    is the target URL itself, later pages come from the pattern (U5) or the
    page parameter (U6)."""
    start = start_page if isinstance(start_page, Column) else F.lit(start_page)
    n = n_pages if isinstance(n_pages, Column) else F.lit(n_pages)
    pages = F.when(n > 0, F.sequence(start, start + n - 1))  # no pages: no rows
    out = targets.withColumn("page_no", F.explode(pages))
    return out.withColumn("page_url", page_url(F.col(url_col), F.col("page_no"), pattern, param))


def with_url_hash(df: DataFrame, url_col: str = "page_url", strip: bool | Column = True) -> DataFrame:
    """U3 (cache form) + U4 as columns ``cache_key`` and ``url_hash``."""
    return (df.withColumn("cache_key", cache_key(url_col, strip))
              .withColumn("url_hash", url_hash("cache_key")))


def limit_per_site(records: DataFrame, site_col: str, order_cols: list[str], n: int) -> DataFrame:
    """The first ``n`` records of each site in page order."""
    w = Window.partitionBy(site_col).orderBy(*[F.col(c).asc() for c in order_cols])
    return records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def url_cap(frontier: DataFrame, order_cols: list[str], cap: int = URL_CAP) -> DataFrame:
    """The first ``cap`` URLs of the run."""
    return frontier.orderBy(*[F.col(c).asc() for c in order_cols]).limit(cap)


def halt_pages(grid: DataFrame, site_col: str = "site", page_col: str = "page",
               items_col: str = "items", max_empty: int = MAX_EMPTY) -> DataFrame:
    """C3 core: per site, the page at which the crawl halts (sites that never
    see ``max_empty`` empty pages in a row are absent)."""
    empty = grid.filter(F.col(items_col) == 0).select(
        site_col, F.explode(F.sequence(F.col(page_col), F.col(page_col) + (max_empty - 1))).alias("_end"))
    runs = empty.groupBy(site_col, "_end").agg(F.count(F.lit(1)).alias("_votes"))
    return (runs.filter(F.col("_votes") == max_empty)
            .groupBy(site_col).agg(F.min("_end").alias("stop_page")))


def crawl_halt(grid: DataFrame, site_col: str = "site", page_col: str = "page",
               items_col: str = "items", max_empty: int = MAX_EMPTY) -> DataFrame:
    """The pages a crawl visits - all pages up to the halting page (all
    pages when it never halts) - with ``stop_page`` (NULL = never halted).
    Page numbers must be dense per site (missing pages zero-filled)."""
    stops = halt_pages(grid, site_col, page_col, items_col, max_empty)
    joined = join_small(grid, stops, site_col, "left")
    return joined.filter(F.col("stop_page").isNull() | (F.col(page_col) <= F.col("stop_page")))


def fresh_cache(cache: DataFrame, as_of, ttl_hours: float = CACHE_TTL_HOURS,
                hash_col: str = "url_hash", ts_col: str = "fetched_at") -> DataFrame:
    """C4: the newest copy per URL hash fetched at or before ``as_of`` and
    younger than ``ttl_hours``; adds ``age_hours``. Times keep their type
    (TIMESTAMP_NTZ stays zone-free; ``as_of`` is cast to the same type)."""
    ts = F.col(ts_col)
    kind = cache.schema[ts_col].dataType.simpleString()
    as_of_c = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast(kind)
    latest = (cache.filter(ts <= as_of_c).groupBy(hash_col)
              .agg(F.max(ts).alias("fetched_at")))
    age = F.timestamp_diff("MICROSECOND", F.col("fetched_at"), as_of_c) / 3.6e9
    return latest.withColumn("age_hours", age).filter(F.col("age_hours") < ttl_hours)


def to_fetch(frontier: DataFrame, fresh: DataFrame, hash_col: str = "url_hash",
             valid: DataFrame | None = None) -> DataFrame:
    """Frontier rows without a fresh cached copy. ``valid`` lists the URL
    hashes whose cached copy still gives a valid record (after V1); a fresh
    copy that gives none is a miss and is fetched again."""
    usable = fresh.select(hash_col)
    if valid is not None:
        usable = usable.join(valid.select(hash_col), hash_col, "left_semi")
    return frontier.join(usable, hash_col, "left_anti")


def crawl_run(frontier: DataFrame, records: DataFrame, limit: int, site_col: str = "site",
              page_col: str = "page", order_cols: list[str] = ("ordinal",),
              max_empty: int = MAX_EMPTY) -> DataFrame:
    """The crawl loop as one batch plan: visit pages in order, halt after
    ``max_empty`` consecutive pages without records (C3), keep at most
    ``limit`` records per site in page order, counted before dedup (C1).

    ``frontier`` lists every (site, page) the crawl may visit (dense page
    numbers); ``records`` are the records extracted from those pages. Both
    steps are partial aggregates or a group-limited window, so a site with a
    third of all pages is not gathered into one task.
    """
    per_page = records.groupBy(site_col, page_col).agg(F.count(F.lit(1)).alias("_items"))
    grid = (frontier.select(site_col, page_col).join(per_page, [site_col, page_col], "left")
            .select(site_col, page_col, F.coalesce("_items", F.lit(0)).alias("_items")))
    stops = halt_pages(grid, site_col, page_col, "_items", max_empty)
    kept = join_small(records, stops, site_col, "left").filter(
        F.col("stop_page").isNull() | (F.col(page_col) <= F.col("stop_page"))).drop("stop_page")
    return limit_per_site(kept, site_col, [page_col, *order_cols], limit)
