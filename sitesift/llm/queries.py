"""The queries of this package, by name, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, license_join, minhash, ngram_trie, pareto, periodic, pieces, quality_rules, resample, toxicity, warc, whiten,
               winnow)
from ._runtime import shipped, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = ", ".join(f"(-1L, {k}L, '{role}', '{said}')" for k, role in enumerate(("user", "assistant")))
    more = spark.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ranks = chat.load_ranks()
    return chat.read_back(*chat.prefix_tree(turns.unionByName(more), ranks), ranks)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_trie.score(docs, ngram_trie.build(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load()).drop("text")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.mix(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.digests(periodic.find_runs(periodic.with_tails(table(spark, sf_dir, "documents"), crc)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: shipped(fn) for name, fn in list(globals().items()) if name.startswith("op")
}
