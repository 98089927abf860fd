"""Corpus pipeline: raw documents to token ids, five stages over the training-
data operators. Each stage takes (spark, docs, sf_dir) and returns a DataFrame;
:func:`run` writes it to the shared folder as Parquet and reads it again as the
next stage's documents. All stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitesift.llm import minhash, pieces, quality_rules, toxicity, winnow
from sitesift.llm._runtime import shipped, table, written


@shipped
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold stay."""
    return toxicity.mild_rows(docs, table(spark, sf_dir, "labels"))


@shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps stay."""
    return quality_rules.kept_rows(docs)


@shipped
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.unique_rows(docs)


@shipped
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return winnow.clean_rows(docs, table(spark, sf_dir, "benchmark"))


@shipped
def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, verified by decoding and against the reference library."""
    return pieces.encoded(docs, pieces.load())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
