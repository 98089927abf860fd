"""A crawl run over landed pages: the batch form of the reference's main loop.

landed pages -> records by each site's strategy, in place (X11) -> frontier
(target, page number, page URL) joined on the URL -> soft validation (V1) ->
fetch stamp (X10) -> halt after empty pages and cap the records per target
(C3 + C1) -> the brief tables (A12) and, when asked, the silver master
(S3/S4). Every step is a DataFrame function; nothing is looped on the
driver except the schema list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_EMPTY
from ..operators import analytics as A
from ..operators.resolve import resolve_site
from ..operators.extract_html import extract_links
from ..operators.route import extract_records, stamp
from ..operators.validate import soft_validate_sites
from ..sources.site_schema import SiteConfig
from .crawl import crawl_run


@dataclass
class CrawlResult:
    records: DataFrame
    brief: dict[str, DataFrame]


def _newest(rows: DataFrame, best: DataFrame, url_col: str, keys: list[str]) -> DataFrame:
    """The rows of the newest copy of each URL, once each."""
    same = ((rows[url_col] == best["_u"]) & rows["_fetched"].eqNullSafe(best["_last"]) & (rows["_body"] == best["_b"]))
    return rows.join(best, same, "left_semi").dropDuplicates(keys).drop("_body")


def crawl_records(frontier: DataFrame, landed: DataFrame, configs: list[SiteConfig],
                  limit: int, target_col: str = "target", page_col: str = "page_no",
                  url_col: str = "page_url", body_col: str = "html",
                  fetched_col: str | None = "fetched_at", max_empty: int = MAX_EMPTY) -> DataFrame:
    """Records of a crawl, as the crawl loop collects them.

    Landed pages are extracted where they lie, with the strategy of the site
    their URL belongs to; only records, links and URLs are shuffled after
    that, never a page body. Index and RSS sites: the records of each frontier
    page that landed. Detail sites: each frontier page is a listing whose links
    under the site's container (X9) lead to detail pages; the records of the
    landed detail pages count for the listing page.

    The raw layer is append-only: of several copies of a URL the one fetched
    last counts (of equal times the one with the larger body hash). Records
    are soft-validated with each site's primary key and stamped with the fetch
    time; pages that did not land count as empty. Each target halts after
    ``max_empty`` empty pages in a row and keeps at most ``limit`` records in
    page order (then link, then position).
    """
    fetched = F.col(fetched_col) if fetched_col else F.lit(None).cast("timestamp")
    pages = landed.select(F.col(url_col).alias("_url"), F.col(body_col).alias("_html"), fetched.alias("_fetched"),
                          F.xxhash64(body_col).alias("_body")).withColumn("_pid", F.xxhash64("_url"))
    best = (pages.groupBy(F.col("_url").alias("_u")).agg(F.max(F.struct("_fetched", "_body")).alias("_c"))
            .select("_u", F.col("_c._fetched").alias("_last"), F.col("_c._body").alias("_b")))
    pages = resolve_site(pages, configs, url_col="_url", id_col="_pid").filter("domain is not null")
    recs = extract_records(pages, configs, id_col="_pid", url_col="_url", body_col="_html", carry=["_fetched", "_body"])
    recs = _newest(recs, best, "source_url", ["source_url", "ordinal"])
    steps = frontier.select(F.col(target_col).alias("_site"), F.col(page_col).alias("_page"), F.col(url_col).alias("_at"))
    direct = [c.domain for c in configs if c.strategy != "detail"]
    detail = [c for c in configs if c.strategy == "detail"]
    parts = []
    if direct:
        on_page = recs.filter(F.col("domain").isin(*direct))
        parts.append(steps.join(on_page, F.col("_at") == F.col("source_url")).withColumn("_link", F.lit("")))
    if detail:
        listing = pages.filter(F.col("domain").isin(*[c.domain for c in detail]))
        links = extract_links(listing, id_col="_pid", url_col="_url", body_col="_html", domain_col="domain",
                              containers={c.domain: c.container or "body" for c in detail}, carry=["_fetched", "_body"])
        links = _newest(links, best, "url", ["url", "link"]).select(F.col("url").alias("_at"), F.col("link").alias("_link"))
        found = recs.filter(F.col("domain").isin(*[c.domain for c in detail]))
        parts.append(steps.join(links, "_at").join(found, F.col("_link") == F.col("source_url")))
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra, allowMissingColumns=True)
    out = soft_validate_sites(out.drop("_at", "_pid"), configs)  # V1, each site's own key, one pass
    if fetched_col:
        out = stamp(out, fetched_at=F.col("_fetched"), from_cache=F.lit(False))
    out = crawl_run(steps.select("_site", "_page"), out.drop("_fetched"), limit, site_col="_site", page_col="_page",
                    order_cols=["_link", "ordinal"], max_empty=max_empty)
    return out.withColumnRenamed("_site", target_col).withColumnRenamed("_page", page_col).drop("_link")


def run_crawl(frontier: DataFrame, landed: DataFrame, configs: list[SiteConfig], limit: int,
              entity_col: str | None = None, **kw) -> CrawlResult:
    """``crawl_records`` plus the brief tables, grouped by site."""
    recs = crawl_records(frontier, landed, configs, limit, **kw)
    brief = A.market_brief(recs, "domain", entity_col=entity_col)
    return CrawlResult(recs, brief)

