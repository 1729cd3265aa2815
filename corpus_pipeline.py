"""The corpus pipeline: toxic documents go, poor ones go, one of each group of near copies stays, and
what is left is packed into sequences. Each stage takes (spark, documents, folder of tables) and works
on all that the stage before kept, which is written as Parquet and read again between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelfold.llm import common, entries, jaccard, packing, quality_rules, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half; learnt from labels that are not held out."""
    common.ship(spark)
    texts, marks = toxicity.sample(docs, entries.learnt_from(spark, sf_dir), "toxic", "doc_id", "text")
    return toxicity.score(docs, *toxicity.train(texts, marks), keep=True, threshold=0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of links at 0.8 on shingles of five words."""
    common.ship(spark)
    return jaccard.deduplicate(docs, percent=80, size=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 4096 tokens."""
    common.ship(spark)
    return packing.pack(docs, entries.tokenizer_path(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]

#: Training and tokenizing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
