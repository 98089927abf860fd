"""The records -> silver flow (the reference's silver processor), per row.

Steps, all lazy DataFrame functions in one pass over the records: V2
required keys -> U3 strip query -> T1 money -> D1 dedup keys -> D6 stamp ->
D4 merge with history -> D3 newest-wins. The schema is resolved per row
(U2), not from the first record; a record without a schema belongs to
``general``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GENERAL, MONEY_COLUMNS  # fixed values
from ..functions.text import money_report, money_silver
from ..functions.urls import strip_query
from ..operators.merge import choose_dedup_keys, merge_history, silver_stamp
from ..operators.resolve import config_lookup, resolve_site
from ..operators.validate import required_ok
from ..sources.site_schema import SiteConfig


def site_columns(cols: list[str], configs: list[SiteConfig]) -> dict[str, list[str]]:
    """Per domain, which columns of a mixed frame its records really have: its
    own fields and the columns that no site lists as a field (provenance). A
    site without a field list, and ``general``, may have any."""
    listed = {n for c in configs for n in c.field_names}
    own = {c.domain: [n for n in cols if n in c.field_names or n not in listed] if c.fields else list(cols)
           for c in configs}
    return {GENERAL: list(cols)} | own


def _by_key_set(configs: list[SiteConfig], keys_of) -> dict[tuple[str, ...], list[str]]:
    """Domains grouped by their (ordered) key list: few distinct lists even
    for many sites, so per-row cost does not grow with the number of sites."""
    out: dict[tuple[str, ...], list[str]] = {}
    for c in configs:
        out.setdefault(tuple(keys_of(c)), []).append(c.domain)
    return out


def to_silver(records: DataFrame, configs: list[SiteConfig], run_ts,
              history: DataFrame | None = None, ts_col: str = "scraped_at",
              tiebreak: list[str] = (), url_col: str = "source_url",
              id_col: str | None = None, money_col: str | None = None,
              keep_key: bool = False) -> DataFrame:
    """Records of any mix of sites -> the merged silver table, in one pass.

    Per-site settings are looked up per row: the strip-query flag from a map
    keyed by domain, the required keys (V2) and dedup keys (D1) through
    ``domain IN (...)`` sets, one per distinct key list. The merge key is
    (domain, that site's key columns) encoded as one struct, so a single
    aggregation serves every site and sites never collapse into each other.
    A record without a schema belongs to ``general`` (no required keys,
    default dedup keys). ``keep_key`` keeps that key as a ``dedup_key``
    column, which later merges into the master use.
    """
    cols = records.columns
    if "domain" not in cols:
        records = resolve_site(records, configs, url_col=url_col, id_col=id_col)
    out = records.withColumn("domain", F.coalesce(F.col("domain"), F.lit(GENERAL)))
    dom = F.col("domain")
    # V2: required keys per site (a site whose key is not a column drops all)
    keep = F.lit(True)
    for keys, domains in _by_key_set(configs, lambda c: c.dedup_keys).items():
        if not keys:
            continue
        ok = required_ok(list(keys)) if all(k in cols for k in keys) else F.lit(False)
        keep = F.when(dom.isin(*domains), ok).otherwise(keep)
    out = out.filter(keep)
    # Strip the query where the site says so (default false)
    if "source_url" in cols:
        flag = F.coalesce(config_lookup(dom, configs, "strip_url_query").cast("boolean"), F.lit(False))
        out = out.withColumn("source_url", strip_query("source_url", flag))
    # Each site's own money column. The column is a number in silver, so a
    # site that has it beside its own money column gets it as a number too.
    own = site_columns(cols, configs)
    kinds = dict(records.dtypes)
    money = {d: money_col or next((m for m in MONEY_COLUMNS if m in has), None) for d, has in own.items()}
    for m in [m for m in (money_col, *MONEY_COLUMNS) if m in cols and m in money.values()]:
        main = [d for d in money if money[d] == m]
        other = [d for d in money if money[d] != m and m in own[d]]
        out = out.withColumn(m, F.when(dom.isin(*main), money_silver(m, kinds[m]))
                             .when(dom.isin(*other), money_report(m, kinds[m])))
    out = silver_stamp(out, run_ts)
    # D1 per site, as one struct key
    key_sets = _by_key_set(configs, lambda c: choose_dedup_keys(own[c.domain], c.dedup_keys))
    key_sets.setdefault(tuple(choose_dedup_keys(cols)), []).append(GENERAL)
    key_cols = sorted({k for ks in key_sets for k in ks})
    key = F.struct(*[
        F.when(dom.isin(*[d for ks, ds in key_sets.items() if k in ks for d in ds]), F.col(k)).alias(k)
        for k in key_cols])
    staged = out.withColumn("dedup_key", key)
    hist = history.withColumn("dedup_key", key) if history is not None else None
    merged = merge_history(hist, staged, ["domain", "dedup_key"], ts_col, list(tiebreak))
    return merged if keep_key else merged.drop("dedup_key")


def publish_silver(records: DataFrame, configs: list[SiteConfig], run_ts, master_root: str,
                   sample_path: str | None = None, snapshot_date=None, ts_col: str = "scraped_at",
                   tiebreak: list[str] = (), url_col: str = "source_url",
                   buckets: int = 1) -> dict[str, int]:
    """The silver processor end to end: clean and key the batch
    (``to_silver``), merge it into the per-domain master (S3/D4, only the
    touched domains are rewritten) and, when asked, write the day's sample
    (S4). Returns the published master version per domain (per part when
    the master is bucketed: ``buckets`` > 1 rewrites only touched buckets)."""
    from ..sources.silver import merge_into_master, merge_sample

    spark = records.sparkSession
    batch = to_silver(records, configs, run_ts, ts_col=ts_col, tiebreak=tiebreak, url_col=url_col,
                      keep_key=True)
    keys = ["domain", "dedup_key"]  # each site's own key columns, as to_silver used them
    # touched domains from a URL-only projection (cheap), not from the batch
    if "domain" in records.columns:
        doms = records.select(F.coalesce("domain", F.lit(GENERAL)).alias("d"))
    else:
        doms = resolve_site(records.select(url_col), configs, url_col=url_col).select(
            F.coalesce("domain", F.lit(GENERAL)).alias("d"))
    touched = [r.d for r in doms.distinct().collect()]  # at most one per configured site
    # the batch feeds the bucket list, the master write and the sample: keep
    # it for this call (a lost block is recomputed from its lineage)
    batch = batch.persist()
    try:
        published, problems = merge_into_master(spark, master_root, batch, keys, ts_col, tiebreak,
                                         domains=touched, buckets=buckets)
        for problem in problems:  # D7: what was skipped in the history
            logging.getLogger(__name__).warning("silver master: %s", problem)
        if sample_path is not None:
            day = F.to_date(F.lit(run_ts)) if snapshot_date is None else snapshot_date
            merge_sample(batch, sample_path, day, touched, ts_col, tiebreak)
    finally:
        batch.unpersist()
    return published
