"""Native (JVM-side) word hashing shared by the operators that run without
Python: words are maximal runs of ASCII letters, digits and non-ASCII
characters, with A-Z lower-cased."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Stands after the last word of every text, so that a text without hits
#: still yields one row in the same pass. No word hashes to it on purpose.
END_MARK = 0x5EED_0000_0000_0001


def lowered(word: Column) -> Column:
    """A-Z lower-cased: ``lower`` where a word is all ASCII (one byte a
    character), else only the 26 letters."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_hashes(text: Column) -> Column:
    """``array<bigint>``: the hash of each word in order; null text: empty."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(lowered(w)))


def hashed(df: DataFrame) -> DataFrame:
    """doc_id, ``th`` (hash of the text: tells rows of one id apart), ``h``."""
    return df.select("doc_id", F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("h"))


def same_rows(a: DataFrame, b: DataFrame):
    """Join condition on (doc_id, th), null-safe."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
