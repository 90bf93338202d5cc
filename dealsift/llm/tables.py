"""Shared helpers of the operators on tables: documents with defined nulls, sizes, and folders all executors see."""

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Null ids are kept and count as the largest id.
NULL_ID = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster gets it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (now := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [now, root]))


def documents(docs: DataFrame, *more) -> DataFrame:
    """Only the needed columns, so that extra ones with clashing names do not matter."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: the one number from which chunk and bucket counts are derived."""
    return int(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0)


def parts(size: int, each: int, least: int = 64) -> int:
    """How many parts of ``each`` bytes: follows the data, and at least enough to use a small cluster."""
    return max(least, -(-size // each))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, evaluates once."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
