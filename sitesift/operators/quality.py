"""Payloads that can't be read, beside the records.

A pass that reads payloads with ``quality=True`` gives records and, for each
payload that failed, one row with the reason, the size and a digest of the
body (``ordinal`` and the fields are null). The body is parsed once; records
and failures are told apart by ``reason`` afterwards.

Reasons: ``missing`` (no body, or blanks only), ``oversize`` (above
``MAX_BYTES``; not parsed), ``unparsable``, ``duplicate_key`` (a JSON object
that names a key twice, which VARIANT refuses), ``malformed_feed`` (read by the
tolerant parser instead: its records are there too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, OVERSIZE, UNPARSABLE, DUPLICATE_KEY, MALFORMED_FEED = (
    "missing", "oversize", "unparsable", "duplicate_key", "malformed_feed")
#: VARIANT's own limit is 128 MiB; a payload is refused well before.
MAX_BYTES = 64 << 20
BLANKS = " \t\n\r\f\v"
QUALITY = ("reason", "body_bytes", "body_sha256")


def early_reason(body: Column, max_bytes: int | None = None) -> Column:
    """Why a body need not be parsed (null: it must be)."""
    limit = MAX_BYTES if max_bytes is None else max_bytes
    return (F.when(body.isNull() | (F.btrim(body, F.lit(BLANKS)) == ""), MISSING)
            .when(F.octet_length(body) > limit, OVERSIZE))


def with_quality(parsed: DataFrame, failed: Column, why: Column) -> DataFrame:
    """``parsed`` (with ``_early`` and ``_body``) with the quality columns,
    null where the body was read."""
    reason = F.coalesce(F.col("_early"), F.when(failed, why))
    bad = reason.isNotNull()
    return parsed.withColumns({"reason": reason, "body_bytes": F.when(bad, F.octet_length("_body").cast("bigint")),
                               "body_sha256": F.when(bad, F.sha2(F.col("_body"), 256))}).drop("_early", "_body")


def quality_rows(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The failures of such a pass."""
    return records.filter(F.col("reason").isNotNull()).select(id_col, "domain", "source_url", *QUALITY)


def good_records(records: DataFrame) -> DataFrame:
    """The records of such a pass."""
    return records.filter(F.col("ordinal").isNotNull()).drop(*QUALITY)
