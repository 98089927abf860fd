"""The flagship query: landed pages to the dominant keywords of their records.

pages -> U2 resolve -> X3 extract (article: title = h1, text = p) -> X7/X8
(inside extraction) -> V1 soft validation -> D3 newest-wins per
(title, source_url) -> A4/A5 top keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..operators import analytics as A
from ..operators.extract_html import extract_html
from ..operators.merge import dedup_newest
from ..operators.resolve import resolve_site
from ..operators.validate import soft_validate


def flagship_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = fx.sites(fx.ARTICLE_TEXT_SITE)
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    recs = extract_html(resolve_site(pages, configs), configs, mode="static")
    valid = soft_validate(recs, configs[0].primary_key)
    return dedup_newest(valid, ["title", "source_url"], "page_id", ["ordinal"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = flagship_records(spark, sf_dir)
    return A.top_keywords(A.keyword_counts(recs, "text"), [], 5)
