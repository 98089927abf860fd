"""Dot-path lookup into JSON (``a.b.0.c``), on Spark's VARIANT type.

A segment steps into an object by key; when the current value is a list, a
(possibly negative) integer segment indexes it. Any failed step gives the
default. Each step is one native expression, so a whole path compiles into a
single codegen'd projection; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col as _c

_INT = re.compile(r"^\s*[+-]?\d+\s*$")


def _get(v: Column, path: str, as_type: str = "variant") -> Column:
    return F.call_function("try_variant_get", v, F.lit(path), F.lit(as_type))


def _keys_path(keys: list[str]) -> str:
    return "$" + "".join('["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in keys)


def json_path(v, path: str) -> Column:
    """Walk ``path`` through a VARIANT column; NULL when any step fails.

    Runs of key segments become one variant path. A numeric segment is an
    index when the value is a list and a key otherwise (the reference decides
    by the value's type, seen only per row): both lookups are tried, and the
    one that does not apply yields NULL.
    """
    cur = _c(v)
    if not path:
        return cur
    keys: list[str] = []
    for seg in path.split("."):
        if not _INT.match(seg):
            keys.append(seg)
            continue
        if keys:
            cur = _get(cur, _keys_path(keys))
            keys = []
        i = int(seg)
        if i >= 0:
            as_index = _get(cur, f"$[{i}]")
        else:
            as_index = F.try_element_at(_get(cur, "$", "array<variant>"), F.lit(i))
        cur = F.coalesce(as_index, _get(cur, _keys_path([seg])))
    return _get(cur, _keys_path(keys)) if keys else cur


def variant_text(v: Column) -> Column:
    """A VARIANT value as text. Doubles between 1e-4 and 1e16 are written out
    in digits (``1e7`` is ``10000000.0``), never with an exponent."""
    text = _get(v, "$", "string")
    number = _get(v, "$", "double")
    size = F.abs(number)
    digits = F.regexp_replace(number.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    written = F.regexp_replace(digits, r"\.$", ".0")
    is_number = F.call_function("schema_of_variant", v) == "DOUBLE"
    # nested, so that the number is read only of a text that looks like one
    plain = F.when((size >= 1e-4) & (size < 1e16), F.when(is_number, written).otherwise(text)).otherwise(text)
    return F.when(text.rlike(r"^-?[0-9.]+E-?[0-9]+$"), plain).otherwise(text)


def json_path_text(v, path: str, default: str | None = "N/A") -> Column:
    """X1 as text: strings unquoted, objects/arrays/numbers/booleans in JSON
    spelling, JSON null and failed lookups -> ``default``."""
    out = variant_text(json_path(v, path))
    return out if default is None else F.coalesce(out, F.lit(default))
