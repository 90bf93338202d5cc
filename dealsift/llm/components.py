"""Connected components of an edge table by alternating large-star and small-star steps.

Each step points neighbours at the smallest id around them, so a group of any shape becomes a star around its smallest
id in a logarithmic number of rounds. A step is an aggregate with partial results and an equi join; no group is held in
one task's memory, and only two numbers per round reach the driver.
"""

from pyspark.sql import DataFrame, functions as F

from dealsift.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable id) for every id in the columns ``a`` and ``b`` of ``edges``."""
    now = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: larger neighbours of u point to the smallest id around u
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        # small star: smaller neighbours of b, and b itself, point to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct()
        now = stored(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    own = now.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(own).distinct()
