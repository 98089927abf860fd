"""V1-V3: soft validation, required keys, validation metrics (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMPTY_MARKERS, PENDING  # noqa: F401 (fixed values)
from ..functions.text import NA, strip_ws


def _present(c: Column, na_is_fallback: bool) -> Column:
    """Python truthiness of a string column (non-null, non-empty); the
    reference's missing marker ``N/A`` is truthy unless na_is_fallback=False."""
    ok = c.isNotNull() & (F.length(c) > 0)
    return ok if na_is_fallback else ok & (c != NA)


def soft_bad(df: DataFrame, primary_key: str) -> Column:
    v = strip_ws(F.col(primary_key))
    return v.isNull() | (v == "") | (v == NA)


def soft_fallback(df: DataFrame, na_is_fallback: bool = True) -> Column:
    has = F.lit(False)
    for c in ("link", "company"):
        if c in df.columns:
            has = has | _present(F.col(c), na_is_fallback)
    return has


def soft_validate(df: DataFrame, primary_key: str | None, na_is_fallback: bool = True) -> DataFrame:
    """V1: a record whose primary key is empty or ``N/A`` is kept only when it
    has a link or company, with the key set to ``N/A - Pending Review``.
    No primary key configured -> everything is kept; a configured key that
    the records lack counts as empty for every record."""
    if not primary_key:
        return df
    if primary_key not in df.columns:  # every record has an empty key
        df = df.withColumn(primary_key, F.lit(None).cast("string"))
    bad = soft_bad(df, primary_key)
    fb = soft_fallback(df, na_is_fallback)
    return (df.filter(~bad | fb)
              .withColumn(primary_key, F.when(bad, F.lit(PENDING)).otherwise(F.col(primary_key))))


def required_ok(keys: list[str]) -> Column:
    """V2 predicate: every key present and not a placeholder after trim+upper."""
    cond = F.lit(True)
    for k in keys:
        v = F.col(k)
        cond = cond & v.isNotNull() & ~F.upper(strip_ws(v)).isin(*EMPTY_MARKERS)
    return cond


def required_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """V2: drop records failing a required key; no keys -> no-op. A key the
    frame lacks counts as missing (the record fails)."""
    if not keys:
        return df
    missing = [k for k in keys if k not in df.columns]
    if missing:
        return df.limit(0)
    return df.filter(required_ok(keys))


def validation_metrics(df: DataFrame, primary_key: str, required: list[str],
                       group_cols: list[str], na_is_fallback: bool = True) -> DataFrame:
    """V3: per group, records in, malformed (dropped by V1), pending review,
    retained by V1, and failing V2 - one aggregation pass, map-side combined."""
    bad = soft_bad(df, primary_key)
    fb = soft_fallback(df, na_is_fallback)
    # a required key that the frame lacks fails every record, as in V2
    req = F.lit(False) if set(required or ()) - set(df.columns) else required_ok(list(required or ()))
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(bad & ~fb).alias("n_malformed"),
        F.count_if(bad & fb).alias("n_pending"),
        F.count_if(~bad | fb).alias("n_retained"),
        F.count_if(~req).alias("n_key_failed"),
    )


def soft_validate_sites(df: DataFrame, configs, domain_col: str = "domain",
                        na_is_fallback: bool = True) -> DataFrame:
    """V1 for records of many sites in one pass: each site's own primary key
    (its first field) decides; sites sharing a key share one ``isin`` test,
    so the cost does not grow with the number of sites."""
    by_pk: dict[str, list[str]] = {}
    for c in configs:
        if c.primary_key:
            by_pk.setdefault(c.primary_key, []).append(c.domain)
    if not by_pk:
        return df
    for pk in by_pk:
        if pk not in df.columns:
            df = df.withColumn(pk, F.lit(None).cast("string"))
    dom = F.col(domain_col)
    bad = F.lit(False)
    for pk, doms in by_pk.items():
        bad = F.when(dom.isin(*doms), soft_bad(df, pk)).otherwise(bad)
    fb = soft_fallback(df, na_is_fallback)
    out = df.withColumn("_bad", bad).filter(~F.col("_bad") | fb)
    for pk, doms in by_pk.items():
        out = out.withColumn(pk, F.when(dom.isin(*doms) & F.col("_bad"), F.lit(PENDING)).otherwise(F.col(pk)))
    return out.drop("_bad")
