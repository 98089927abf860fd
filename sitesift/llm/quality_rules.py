"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row stores what was
measured and one bit per rule (set: the rule fails). Policies are versioned
sets of bits: applying one, comparing two and computing ablations are bitwise
expressions over the ledger, so the texts are never read again.

Defined cases: a null or empty text has no words, all measurements 0, and
fails the length rule. Every input row gives one ledger row, repeated rows
too; a null doc_id stays null. An empty table gives an empty ledger. A clashing
column of the input is dropped in :func:`ledger`; :func:`kept_rows` carries
all input columns through a struct of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
LEDGER = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
WINDOW_WORDS = 3
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_LINE_SEP = np.zeros(256, bool)
_LINE_SEP[ord("\n")] = True


def rules() -> list[tuple[str, Column]]:
    """(name, fails) in bit order; append only, a bit never changes its rule."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        ("too_few_words", words < 50),
        ("repeated_windows", 100 * F.col("n_repeat_words") > 50 * words),
        ("symbols", 10 * F.col("n_symbols") > 3 * words),
        ("duplicate_lines", (F.col("n_dup_lines") > 2) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
        ("short_words", chars < 2 * words),
        ("long_words", chars > 20 * words),
        ("too_many_words", words > 10_000_000),
    ]


#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "clean-2": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
}
CURRENT = "clean-2"


def policy_mask(version: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def _per_doc(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)


def measure_slice(s: T.Slice) -> dict[str, np.ndarray]:
    begin, end, doc = s.spans(T.SPACE_SEP)
    words = s.hashes(begin, end, lower=False)
    points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    chars = np.bincount(doc, weights=points[end] - points[begin], minlength=s.n).astype(np.int64)
    symbols = np.searchsorted(s.ends, np.flatnonzero(_IS_SYMBOL[s.data]), side="right")

    # Lines with a word that equal an earlier line of the same text.
    lb, le, ld = s.spans(_LINE_SEP)
    line = s.hashes(lb, le, lower=False)
    used = np.searchsorted(begin, le) > np.searchsorted(begin, lb)
    line, ld = line[used], ld[used]
    key = np.sort((ld.astype(np.uint64) << np.uint64(64 - T.DOC_BITS)) | (line >> T.HASH_SHIFT))
    again = T.owner_of(key[1:][key[1:] == key[:-1]]) if len(key) else ld

    # Words inside a window of three that occurs twice or more in its text.
    gram, at = T.grams(words, doc, WINDOW_WORDS)
    covered = np.zeros(len(words) + WINDOW_WORDS, bool)
    if len(gram):
        key = (doc[at].astype(np.uint64) << np.uint64(64 - T.DOC_BITS)) | (gram >> T.HASH_SHIFT)
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            start = at[twice[place] == key]
            for k in range(WINDOW_WORDS):
                covered[start + k] = True
    return {
        "n_words": _per_doc(doc, s.n), "word_chars": chars, "n_symbols": _per_doc(symbols, s.n),
        "n_dup_lines": _per_doc(again, s.n), "n_lines": _per_doc(ld, s.n),
        "n_repeat_words": _per_doc(doc[covered[:len(words)]], s.n),
    }


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for s in T.slices(batch.column("text")):
            got = measure_slice(s)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(s.first, s.n), *(pa.array(got[m], pa.int64()) for m in MEASURES)],
                names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits``: one pass over the texts."""
    bits = F.lit(0).cast("bigint")
    measured = docs.select("doc_id", "text").mapInArrow(measure, LEDGER)
    for bit, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("failed_bits", bits)


def rejected(version: str = CURRENT) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version))) != 0


def verdicts(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; a document
    that the base policy fails is never kept."""
    base = rejected("base-1")
    return led.withColumns({"base_failed": base, "kept": ~base & ~rejected(version)})


def ablations(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents fail it, how many only it
    rejects, and how many stay once it is dropped. One aggregate over bits."""
    mask = policy_mask(version)
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(bits == 0).alias("stay")]
    names = [name for name, _ in rules()]
    for rule in POLICIES[version]:
        bit = 1 << names.index(rule)
        aggs += [F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"{rule}_fail"),
                 F.count_if(bits == bit).alias(f"{rule}_only")]
    one = led.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"{rule}_fail").alias("n_fail"),
                              F.col(f"{rule}_only").alias("n_only"),
                              (F.col("stay") + F.col(f"{rule}_only")).alias("n_kept_without"))
                     for rule in POLICIES[version]])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def kept_rows(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, all columns as they came: the
    measuring runs as an Arrow function beside the row, without a join."""
    from pyspark.sql.functions import arrow_udf

    kind = "struct<" + ", ".join(f"{m}:bigint" for m in MEASURES) + ">"

    @arrow_udf(kind)
    def measured(text: pa.Array) -> pa.Array:
        parts = [measure_slice(s) for s in T.slices(text)]
        arrays = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64())
                  for m in MEASURES]
        return pa.StructArray.from_arrays(arrays, names=list(MEASURES))

    row = docs.select(F.struct("*").alias("_row"), measured(F.col("text")).alias("_m"))
    flat = row.select("_row", *[F.col("_m")[m].alias(m) for m in MEASURES])
    bits = F.lit(0).cast("bigint")
    for bit, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    drop = policy_mask(version) | policy_mask("base-1")
    return flat.withColumn("_bits", bits).filter(F.col("_bits").bitwiseAND(F.lit(drop)) == 0).select("_row.*")
