"""The text pipeline: language, near-duplicates, repeated passages, benchmark passages, byte-pair codes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of ``documents``. Each stage states what it does with nulls, empty texts and
repeated rows in its operator's module.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealsift.llm import bpe, decontaminate, language, near_dedup, substring
from dealsift.llm.catalog import tokenizer
from dealsift.llm.tables import read, stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    return language.keep_identified(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near-duplicates."""
    return near_dedup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; documents of which nothing is left stay, with an empty text."""
    cut = substring.remove_repeats(docs, rewrite=True)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each document."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", identify),
    ("near-dedup", unique),
    ("substring-dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("bpe", encode),
]

#: No SQL: predictions of a trained model and the tokenizer are beyond it. tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
