"""Records out of RSS / Atom feeds.

Native first: ``from_xml`` with a schema built from the config (container tag
under ``channel`` for RSS, or at the root for Atom), then ``posexplode``. A
malformed feed gives a NULL struct from ``from_xml`` (``xpath`` would fail the
whole job instead); those rows, and only those, go through the tolerant
static HTML job with the same tag names as selectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_field
from ..sources.site_schema import SiteConfig
from .extract_html import extract_html
from .quality import MALFORMED_FEED, early_reason, with_quality


def _xml_schema(container: str, fields: list[str]) -> str:
    item = "STRUCT<" + ", ".join(f"`{f}`: STRING" for f in fields) + ">"
    return f"channel STRUCT<`{container}`: ARRAY<{item}>>, `{container}` ARRAY<{item}>"


def extract_rss(pages: DataFrame, cfg: SiteConfig, id_col: str = "page_id",
                url_col: str = "url", body_col: str = "html",
                domain_col: str = "domain", carry: list[str] = (), quality: bool = False) -> DataFrame:
    """RSS-strategy pages of one site config -> wide records; with ``quality``
    a row of its own for each feed that is missing, too large or malformed."""
    container = cfg.container or "item"
    tags = [r.selectors[0] if r.selectors else r.name for r in cfg.fields]
    if quality:
        pages = pages.withColumn("_early", early_reason(F.col(body_col)))
        early = pages.filter(F.col("_early").isNotNull())
        pages = pages.filter(F.col("_early").isNull())
    parsed = pages.select(id_col, url_col, body_col, domain_col, *carry,
                          F.from_xml(F.col(body_col), _xml_schema(container, sorted(set(tags)))).alias("_x"))
    items = F.coalesce(F.col("_x.channel")[container], F.col("_x")[container])
    good = parsed.filter(items.isNotNull()).select(
        id_col, url_col, domain_col, *carry, F.posexplode(items).alias("ordinal", "_it"))
    out_cols = [F.col(id_col), F.col(domain_col).alias("domain"), F.col(url_col).alias("source_url"),
                F.col("ordinal").cast("int").alias("ordinal")]
    out_cols += [clean_field(r.name, F.col("_it")[tag]).alias(r.name) for r, tag in zip(cfg.fields, tags)]
    out_cols += [F.col(c) for c in carry]
    native = good.select(*out_cols)
    broken = parsed.filter(items.isNull() & F.col(body_col).isNotNull()).drop("_x")
    tolerant = extract_html(broken, [cfg], mode="static", id_col=id_col, url_col=url_col,
                            body_col=body_col, domain_col=domain_col, carry=list(carry))
    records = native.unionByName(tolerant)
    if not quality:
        return records
    shown = [F.col(id_col), F.col(domain_col).alias("domain"), F.col(url_col).alias("source_url"), *carry, F.col(body_col).alias("_body")]
    failed = with_quality(early.select(*shown, "_early"), F.lit(False), F.lit(None)).unionByName(
        with_quality(broken.select(*shown, F.lit(None).cast("string").alias("_early")), F.lit(True), F.lit(MALFORMED_FEED)))
    return records.unionByName(failed, allowMissingColumns=True)
