"""X10 + X11: route landed pages by strategy and stamp provenance.

Strategies: ``json`` -> X2, ``rss`` -> X4, ``index`` -> rendered-DOM mode (X5),
``detail`` (default) -> static mode (X3). Each branch is a filter on the
resolved strategy, the results are unioned by name. A custom parser is an
``Iterator[pd.DataFrame]`` function run with ``mapInPandas``.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.site_schema import SiteConfig
from .extract_html import extract_html
from .extract_json import extract_json
from .extract_xml import extract_rss
from .joins import stored
from .quality import early_reason, with_quality
from .resolve import config_lookup, resolve_site



def extract_records(pages: DataFrame, configs: list[SiteConfig], id_col: str = "page_id",
                    url_col: str = "url", body_col: str = "html",
                    domain_col: str = "domain", carry: list[str] = (), quality: bool = False) -> DataFrame:
    """Pages -> records of every configured site, routed by strategy;
    ``carry`` columns pass through every branch unchanged. With ``quality``
    the rows of ``quality.py`` stand among the records (pages of HTML sites
    have one where the body is missing).

    The site's strategy alone picks the parser, as it did when the page was
    landed; the raw layer's ``format`` label never changes which records come
    out.
    """
    if domain_col not in pages.columns:
        pages = resolve_site(pages, configs, url_col=url_col, id_col=id_col, out_col=domain_col)
    strategy = config_lookup(F.col(domain_col), configs, "strategy")
    staged = pages.withColumn("_strategy", strategy)
    if len({"html" if c.strategy not in ("json", "rss") else c.domain if c.strategy == "rss" else "json" for c in configs}) > 1:
        # landed pages are made once, and a branch reads only its own
        staged = stored(staged.filter(F.col("_strategy").isNotNull()).select(
            *dict.fromkeys([id_col, url_col, body_col, domain_col, *carry, "_strategy"])), "routed", ["_strategy"])
    parts: list[DataFrame] = []
    kw = dict(id_col=id_col, url_col=url_col, body_col=body_col, domain_col=domain_col, carry=list(carry))
    by_strategy: dict[str, list[SiteConfig]] = {}
    for c in configs:
        by_strategy.setdefault(c.strategy, []).append(c)
    html_cfgs = [c for c in configs if c.strategy not in ("json", "rss")]
    if html_cfgs:  # index (DOM mode) and detail (static) sites share one pass
        branch = staged.filter(~F.col("_strategy").isin("json", "rss")).drop("_strategy")
        parts.append(extract_html(branch, html_cfgs, mode=None, **kw))
        if quality:
            lost = branch.withColumn("_early", early_reason(F.col(body_col))).filter("_early = 'missing'")
            parts.append(with_quality(lost.select(
                id_col, F.col(domain_col).alias("domain"), F.col(url_col).alias("source_url"), *carry,
                F.lit(None).cast("int").alias("ordinal"), "_early", F.col(body_col).alias("_body")), F.lit(False), F.lit(None)))
    if by_strategy.get("json"):
        branch = staged.filter(F.col("_strategy") == "json").drop("_strategy")
        parts.append(extract_json(branch, by_strategy["json"], quality=quality, **kw))
    for c in by_strategy.get("rss", []):
        branch = staged.filter((F.col("_strategy") == "rss") & (F.col(domain_col) == c.domain)).drop("_strategy")
        parts.append(extract_rss(branch, c, quality=quality, **kw))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stamp(records: DataFrame, fetched_at=None, from_cache=None, overwrite: bool = True) -> DataFrame:
    """Provenance. ``overwrite`` sets ``scraped_at`` from the fetch time
    (fetched rows); otherwise only where it is missing (index rows)."""
    ts = fetched_at if fetched_at is not None else F.lit(None).cast("timestamp")
    if "scraped_at" in records.columns and not overwrite:
        out = records.withColumn("scraped_at", F.coalesce(F.col("scraped_at"), ts))
    else:
        out = records.withColumn("scraped_at", ts)
    if from_cache is not None:
        out = out.withColumn("from_cache", from_cache)
    return out


def extract_with(pages: DataFrame, parser: Callable[[pd.DataFrame], pd.DataFrame],
                 schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """X11: run a user parser (pandas frame of pages -> frame of records) on
    Arrow batches. Project the columns it needs first so the scan prunes."""
    src = pages.select(*columns) if columns else pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield parser(pdf)

    return src.mapInPandas(run, schema)
