"""URL columns (U1, U3-U6, U8): native expressions, whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col as _c


def netloc(url) -> Column:
    """Text after the last ``//`` up to the next ``/``, every ``www.`` removed.

    Kept as the reference defines it: a later ``//`` in the path wins, and
    ``:port`` or a ``?``/``#`` right after the host stay in.
    """
    u = _c(url)
    # the piece after the last '//' of a left-to-right, non-overlapping split
    # (so 'a///b' gives '/b', as Python's str.split does)
    tail = F.regexp_extract(u, r"(?s)^(?:.*?//)*(.*)$", 1)
    return F.replace(F.substring_index(tail, "/", 1), F.lit("www."), F.lit(""))


def strip_query(url, enabled=True) -> Column:
    """U3 (silver form): drop ``?query`` but keep ``#fragment``.

    Anchored so that a ``?`` that only occurs inside the fragment stays.
    ``enabled`` may be a bool or a boolean Column (null counts as false).
    """
    u = _c(url)
    stripped = F.regexp_replace(u, r"^([^#?]*)\?[^#]*", "$1")
    if isinstance(enabled, bool):
        return stripped if enabled else u
    return F.when(F.coalesce(enabled, F.lit(False)), stripped).otherwise(u)


def cache_key(url, strip=True) -> Column:
    """U3 (cache form): everything from the first ``?`` goes, fragment included."""
    u = _c(url)
    cut = F.substring_index(u, "?", 1)
    if isinstance(strip, bool):
        return cut if strip else u
    return F.when(F.coalesce(strip, F.lit(True)), cut).otherwise(u)


def url_hash(key) -> Column:
    """U4: first 16 hex digits of the MD5 of the cache-key URL."""
    return F.substring(F.md5(_c(key)), 1, 16)


def _decode(c: Column) -> Column:
    # Python's unquote_plus keeps a malformed escape ('%' not followed by two
    # hex digits) as written and decodes the rest: escape those first
    fixed = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.call_function("try_url_decode", fixed), c)


def _query_pairs(query: Column) -> Column:
    """``parse_qsl`` of a query string: ARRAY<STRUCT<k, v>> in order, keys and
    values decoded, ``v`` NULL for a blank value or a pair without '='."""
    return F.transform(
        F.split(F.coalesce(query, F.lit("")), "&"),
        lambda kv: F.struct(
            _decode(F.substring_index(kv, "=", 1)).alias("k"),
            F.when(F.instr(kv, "=") > 0,
                   F.nullif(_decode(F.substring(kv, F.instr(kv, "=") + 1, F.length(kv))), F.lit("")))
            .alias("v")))


def _query_of(u: Column) -> Column:
    no_frag = F.substring_index(u, "#", 1)
    return F.when(F.instr(no_frag, "?") > 0, F.substring(no_frag, F.instr(no_frag, "?") + 1, F.length(no_frag)))


def _query_param(url: Column, name: str) -> Column:
    """``parse_qs(query).get(name)[0]``: the first non-blank value, decoded."""
    hits = F.filter(_query_pairs(_query_of(url)), lambda e: (e["k"] == name) & e["v"].isNotNull())
    return F.try_element_at(hits, F.lit(1))["v"]


def page_url_from_pattern(url, pattern, page) -> Column:
    """Fill ``{base_url}``, ``{base_clean}``, ``{query}`` and ``{i}``.

    ``base_url`` is the URL without trailing ``/``; ``base_clean`` is
    scheme + host + path without trailing ``/``; ``query`` is the ``k``
    parameter, else ``q``, else empty.
    """
    u, pat, i = _c(url), _c(pattern), _c(page)
    base_url = F.regexp_replace(u, "/+$", "")
    base_clean = F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")
    k = _query_param(u, "k")
    q = _query_param(u, "q")
    query = F.coalesce(F.when(k != "", k), F.when(q != "", q), F.lit(""))
    out = F.replace(pat, F.lit("{base_url}"), base_url)
    out = F.replace(out, F.lit("{base_clean}"), base_clean)
    out = F.replace(out, F.lit("{query}"), query)
    return F.replace(out, F.lit("{i}"), i.cast("string"))


def _py_quote_plus(c: Column) -> Column:
    # Python's quote_plus keeps '~' and encodes '*'; Java's URLEncoder does the
    # opposite. Everything else agrees.
    enc = F.call_function("url_encode", c)
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def page_url_with_param(url, page, param="page") -> Column:
    """Set the page parameter, as ``parse_qs`` + ``urlencode(doseq=True)`` do.

    Blank parameters are dropped; repeated keys are grouped next to their
    first occurrence; the target key keeps its position (with the new value)
    or is appended; keys and values are re-encoded; the fragment is kept.
    """
    u, p = _c(url), _c(page).cast("string")
    param_c = param if isinstance(param, Column) else F.lit(param)
    no_frag = F.substring_index(u, "#", 1)
    # the fragment is everything from the first '#'
    frag = F.when(F.instr(u, "#") > 0, F.substring(u, F.instr(u, "#"), F.length(u))).otherwise(F.lit(""))
    base = F.substring_index(no_frag, "?", 1)
    pairs = _query_pairs(_query_of(u))
    kept = F.filter(pairs, lambda e: (F.coalesce(F.length(e["v"]), F.lit(0)) > 0) & (e["k"] != param_c))
    keys = F.transform(pairs, lambda e: F.when(F.coalesce(F.length(e["v"]), F.lit(0)) > 0, e["k"]))
    target_pos = F.array_position(keys, param_c)
    ranked = F.transform(
        kept, lambda e, i: F.struct(F.array_position(keys, e["k"]).alias("g"), i.alias("i"),
                                    e["k"].alias("k"), e["v"].alias("v")))
    target = F.struct(
        F.when(target_pos > 0, target_pos).otherwise(F.lit(1 << 30)).cast("long").alias("g"),
        F.lit(-1).alias("i"), param_c.alias("k"), p.alias("v"))
    ordered = F.sort_array(F.array_union(ranked, F.array(target)))  # by (group, position)
    encoded = F.array_join(
        F.transform(ordered, lambda e: F.concat(_py_quote_plus(e["k"]), F.lit("="), _py_quote_plus(e["v"]))),
        "&")
    return F.concat(base, F.lit("?"), encoded, frag)


def page_url(url, page, pattern=None, param="page") -> Column:
    """U7 building block: page <= 1 is the URL itself; else U5 when a pattern
    is configured, otherwise U6."""
    u, i = _c(url), _c(page)
    if pattern is None:
        built = page_url_with_param(u, i, param)
    else:
        pat = pattern if isinstance(pattern, Column) else F.lit(pattern)
        p_param = param if isinstance(param, Column) else F.lit(param)
        built = F.when(pat.isNotNull(), page_url_from_pattern(u, pat, i)).otherwise(
            page_url_with_param(u, i, F.coalesce(p_param, F.lit("page"))))
    return F.when(i <= 1, u).otherwise(built)


def storage_label(domain) -> Column:
    """U8: characters outside letters, digits and ``._-`` become ``_``;
    a missing domain is ``general``."""
    d = F.coalesce(_c(domain), F.lit("general"))
    return F.regexp_replace(d, r"[^\p{L}\p{N}._-]", "_")


def storage_prefix(domain) -> Column:
    """U8: the part of the label before the first dot (display only)."""
    return F.substring_index(storage_label(domain), ".", 1)
