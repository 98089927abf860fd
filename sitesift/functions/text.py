"""Text and money columns (X7, X8, T1, T2, A4 tokens): native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col as _c
from ..constants import NA, STOP_WORDS, TITLE_FIELDS, TITLE_NUMBER  # noqa: F401 (fixed values)


# Named entities that occur in landed pages, decoded by the native page_title
# column (the HTML jobs decode every entity through the stdlib parser).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&"))

# Whitespace as Python's str.split() sees it: Java's \s is ASCII only, so add
# the Unicode separators, NEL and the four information separators \x1c-\x1f.
WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
# A word as Python's \w sees it (letters, digits, underscore; Unicode aware).
WORD = r"[\p{L}\p{N}_]+"


# Every character Python's str.isspace() accepts (what str.strip() removes).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: a plain character trim (linear, no regex)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def collapse_ws(c) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), WS, " "))


def normalize_text(c) -> Column:
    """Collapse whitespace, trim; empty or missing becomes ``N/A``."""
    return F.coalesce(F.nullif(collapse_ws(c), F.lit("")), F.lit(NA))


def strip_title_number(c) -> Column:
    """Remove a leading number such as ``12`` or ``3.5`` and the spaces after it."""
    return F.regexp_replace(_c(c), TITLE_NUMBER, "")


def clean_field(name: str, c) -> Column:
    """X7 + X8 in the order the static parser applies them: collapse,
    strip the number for title fields, then empty -> ``N/A``."""
    v = collapse_ws(c)
    if name in TITLE_FIELDS:
        v = strip_title_number(v)
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(NA))


def money_report(c, kind: str = "string") -> Column:
    """A number column as it is; a text column by its digits and dots,
    parsed as double. Unparsable -> NULL. ``kind`` is the column's type, as
    ``DataFrame.dtypes`` spells it."""
    if kind != "string":
        return _c(c).cast("double")
    digits = F.trim(F.regexp_replace(_c(c).cast("string"), r"[^0-9.]", ""))
    return digits.try_cast("double")


def money_silver(c, kind: str = "string") -> Column:
    """As T2, unparsable -> 0.0 (the silver layer never holds NULL money)."""
    return F.coalesce(money_report(c, kind), F.lit(0.0))


def money_history(c) -> Column:
    """Money of an earlier snapshot, already a number's text: a plain
    numeric parse without a character filter; unparsable -> 0.0."""
    return F.coalesce(strip_ws(_c(c).cast("string")).try_cast("double"), F.lit(0.0))


# HTML names that are also recognised without the ';' (the legacy set).
LEGACY_NO_SEMICOLON = ("lt", "gt", "quot", "nbsp", "copy", "middot", "amp")


def decode_entities(c) -> Column:
    """Decode the named entities listed in ENTITIES (``&amp;`` last), legacy
    names also without ';' when a non-alphanumeric character or the end
    follows (a title cut after ``&amp`` still reads ``&``)."""
    out = _c(c)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
        name = ent[1:-1]
        if name in LEGACY_NO_SEMICOLON:
            out = F.regexp_replace(out, f"&{name}(?![A-Za-z0-9;])", ch.replace("\\", "\\\\").replace("$", "\\$"))
    return out


NON_WORD = r"[^\p{L}\p{N}_]+"


def words(c) -> Column:
    """A4 split: lower-cased words (Python ``\\b\\w+\\b``), possibly with
    empty strings at the ends; pair with ``keep_word`` after ``explode``
    (a plain filter stays in whole-stage codegen, a lambda would not)."""
    return F.split(F.lower(_c(c)), NON_WORD)


def keep_word(w) -> Column:
    """A4 filter: not empty and not a stop word (an InSet lookup)."""
    w = _c(w)
    return (w != "") & ~w.isin(*STOP_WORDS)

