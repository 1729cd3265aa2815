"""Queries of the operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, oracle, packing, quality_classifier, quality_rules, sentencepiece, sharding, token_files, topk, toxicity
from .common import held_out, read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), [1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def learnt_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows that are not held out."""
    return read(spark, sf_dir, "labels").filter(~held_out())


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> tuple:
    return toxicity.train(*toxicity.sample(read(spark, sf_dir, "documents"), learnt_from(spark, sf_dir), "toxic", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(toxicity.score(read(spark, sf_dir, "documents"), *toxicity_model(spark, sf_dir)), 0.5)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(quality_classifier.classify(read(spark, sf_dir, "documents"), learnt_from(spark, sf_dir)), 0.3)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), percent=90, size=3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_exact_top_k, op4_quality_classifier, op5_quality_rules, op6_token_files, op7_license_scans, op8_sentencepiece, op9_jaccard_join, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
