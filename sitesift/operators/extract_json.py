"""Records out of JSON payloads, fully native (VARIANT).

The container path gives the list of records; a non-list value is wrapped
when truthy, else there are no records; one row per element (posexplode gives
the ordinal). Each field is an X1 dot path, rendered as text and trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import json_path, variant_text
from ..functions.text import NA, TITLE_FIELDS, strip_title_number, strip_ws
from ..sources.site_schema import SiteConfig
from .extract_html import record_columns
from .quality import DUPLICATE_KEY, QUALITY, UNPARSABLE, early_reason, with_quality



def _truthy(v: Column) -> Column:
    kind = F.call_function("schema_of_variant", v)
    text = F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))
    num = F.call_function("try_variant_get", v, F.lit("$"), F.lit("double"))
    return (F.when(v.isNull() | F.call_function("is_variant_null", v), F.lit(False))
            .when(kind == "STRING", F.length(text) > 0)
            .when(kind == "BOOLEAN", text == "true")
            .when(kind.startswith("OBJECT"), text != "{}")
            .when(num.isNotNull(), num != 0)
            .otherwise(F.lit(True)))


def records_array(c: Column) -> Column:
    """ARRAY<VARIANT> of the records in container value ``c``: the list
    itself, a truthy non-list wrapped, else empty."""
    as_list = F.call_function("try_variant_get", c, F.lit("$"), F.lit("array<variant>"))
    return F.coalesce(as_list, F.when(_truthy(c), F.array(c)), F.array().cast("array<variant>"))


def _clean(name: str, raw: Column) -> Column:
    v = strip_ws(F.coalesce(raw, F.lit(NA)))
    if name in TITLE_FIELDS:
        v = strip_title_number(v)
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(NA))


def _per_domain(dom: Column, items: list[tuple[str, Column]]) -> Column:
    expr = None
    for d, e in items:
        expr = F.when(dom == d, e) if expr is None else expr.when(dom == d, e)
    return expr if expr is not None else F.lit(None)


def extract_json(pages: DataFrame, configs: list[SiteConfig], id_col: str = "page_id",
                 url_col: str = "url", body_col: str = "html",
                 domain_col: str = "domain", carry: list[str] = (), quality: bool = False,
                 max_bytes: int | None = None) -> DataFrame:
    """JSON-strategy pages -> wide records (same layout as the HTML jobs).

    With ``quality`` a payload that can't be read gives one row of its own,
    with the reason (see ``quality.py``), among the records of the same pass.

    Staged projections (parse -> container -> records -> raw field values ->
    cleaned text) so every parse and lookup runs once per row; Spark does
    not inline an expensive expression that a later step uses twice.
    """
    configs = [c for c in configs if c.fields]
    names = record_columns(configs)
    dom = F.col(domain_col)
    base = [F.col(id_col), dom.alias("domain"), F.col(url_col).alias("source_url"), *carry]
    keep = [id_col, "domain", "source_url", *carry]
    body = F.col(body_col)
    if quality:
        pages = pages.withColumn("_early", early_reason(body, max_bytes))
        body = F.when(F.col("_early").isNull(), body)
    parsed = pages.select(*base, F.call_function("try_parse_json", body).alias("_doc"),
                          *([F.col("_early"), F.col(body_col).alias("_body")] if quality else []))
    if quality:
        keep += list(QUALITY)
        parsed = with_quality(parsed, F.col("_doc").isNull(), F.when(
            F.get_json_object("_body", "$").isNotNull(), DUPLICATE_KEY).otherwise(UNPARSABLE))
    contained = parsed.select(*keep, _per_domain(F.col("domain"), [
        (c.domain, json_path(F.col("_doc"), c.container or "")) for c in configs]).alias("_c"))
    explode = F.posexplode_outer if quality else F.posexplode
    exploded = contained.select(*keep, explode(records_array(F.col("_c"))).alias("ordinal", "_rec"))
    if quality:
        exploded = exploded.filter("ordinal is not null or reason is not null")
    raw_cols = []
    for n in names:
        items = [(c.domain, json_path(F.col("_rec"), r.selectors[0] if r.selectors else ""))
                 for c in configs for r in c.fields if r.name == n]
        raw_cols.append(_per_domain(F.col("domain"), items).alias(n))
    found = exploded.select(*keep, F.col("ordinal").cast("int").alias("ordinal"), *raw_cols)
    raw = found.select(*keep, "ordinal", *[variant_text(F.col(n).cast("variant")).alias(n) for n in names])
    defined = {n: [c.domain for c in configs if n in c.field_names] for n in names}
    here = F.col("ordinal").isNotNull() if quality else F.lit(True)
    return raw.select(id_col, "domain", "source_url", "ordinal", *[
        F.when(here & F.col("domain").isin(*defined[n]), _clean(n, F.col(n))).alias(n) for n in names],
        *carry, *(QUALITY if quality else ()))
