"""Filters on expensive computed columns."""

from pyspark.sql import Column, DataFrame, functions as F


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Filter that reads computed columns instead of recomputing them.

    The optimizer moves filters below projections by copying the column expressions into the
    filter, once per use.  For columns made of dozens of pattern matches that costs more than the
    rows it saves, so a row number, which filters may not pass, holds the filter where it is.
    """
    fenced = df.withColumn("_fence", F.monotonically_increasing_id())
    return fenced.filter((F.col("_fence") >= 0) & condition).drop("_fence")
