"""Stored tables: versioned snapshots with keyed writes, and append-only history."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealsift.operators.snapshot import upsert


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions of a snapshot table, oldest first."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Latest finished version, optionally the latest one below a number; None when there is none."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/version={known[-1]}") if known else None


def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write one version.  Writing it again after a failure gives the same table."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def upsert_sink(updates: DataFrame, root: str, keys: list[str], overwrite: list[str], version: int, order: tuple[str, ...] = (),
                earliest: tuple[str, ...] = ()) -> None:
    """New version: the version before it with the updates applied.  Running it twice changes nothing."""
    current = read_snapshot(updates.sparkSession, root, before=version)
    merged = updates if current is None else upsert(current, updates, keys, overwrite, order, earliest)
    write_snapshot(merged, root, version)


def history_append(observations: DataFrame, root: str, time: str = "observed_at", batch: int | None = None) -> None:
    """Append observations partitioned by day.  A batch number gets a folder of its own, so a retry
    replaces it instead of appending twice."""
    dated = observations.withColumn("observed_date", F.to_date(time))
    if batch is None:
        dated.write.mode("append").partitionBy("observed_date").parquet(root)
    else:
        dated.write.mode("overwrite").partitionBy("observed_date").parquet(f"{root}/batch={batch}")
