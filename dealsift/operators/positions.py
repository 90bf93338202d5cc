"""Row numbers of a total order without one task that sees all rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealsift.session import shared_folder

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, place in the partition below


def with_position(df: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """Add the place of each row in the order, from 1.

    Rows are dealt into ranges of the order and sorted there; a range's first place is the number of rows in the ranges
    before it, a table with one row a range. Ranges are drawn from a sample and would differ in a second run, so the
    sorted rows are written once to the shared folder. The order should tell rows apart: rows that are equal in it lie
    in one range, in any order.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    folder = shared_folder(spark, "positions")
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("_range", F.shiftright("_at", _LOCAL_BITS))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_range", before.alias("_before"))  # as many rows as ranges
    placed = rows.join(F.broadcast(firsts), "_range")
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return placed.withColumn(name, F.col("_before") + local + 1).drop("_range", "_at", "_before")


def with_position_in_groups(df: DataFrame, group: str, order: list[Column], name: str = "position", rows_per_task: int = 2_000_000) -> DataFrame:
    """Add the place of each row in the order of ``group`` (ascending, missing last), then ``order``, from 1.

    For a leading column with far fewer values than rows: rows are counted per value, the counts of the values before are
    added up, and rows are dealt by value once; only the counts are written. They are counted in a run of their own, so the
    frame is worked out twice. Rows of a value with more than a task should see take their place from ``with_position``.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "counts")
    df.groupBy(F.col(group).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).write.parquet(folder)
    counts = spark.read.parquet(folder).withColumn("_many", F.when(F.col("_n") > rows_per_task, F.col("_n")).otherwise(F.lit(0)))
    total, many = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_many"), F.lit(0))).first()
    # as many rows as values
    earlier = Window.orderBy(F.asc_nulls_last("_value")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = F.broadcast(counts.select(
        "_value", (F.col("_many") > 0).alias("_crowded"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_crowded_before")))
    same = F.col(group).eqNullSafe(F.col("_value"))
    crowded = F.broadcast(counts.filter("_many > 0").select("_value"))

    def placed(rows: DataFrame, place: Column) -> DataFrame:
        return rows.join(firsts, same).withColumn(name, place).select(*df.columns, name)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_task))
    few = df.join(crowded, same, "left_anti") if many else df
    # windows normalize fractions, so rows dealt by a fraction itself would be dealt once more
    slot = F.hash(group)
    local = F.row_number().over(Window.partitionBy(slot, group).orderBy(*order))
    result = placed(few.repartition(parts, slot).withColumn("_place", local), F.col("_before") + F.col("_place"))
    if not many:
        return result
    rest = with_position(df.join(crowded, same, "left_semi"), [F.asc_nulls_last(group), *order], "_place")
    return result.unionByName(placed(rest, F.col("_before") - F.col("_crowded_before") + F.col("_place")))


def ordered(df: DataFrame, order: list[Column], position: str | None = None) -> DataFrame:
    """Rows in order, or with their place in it as a column, which outlives writing."""
    return df.orderBy(*order) if position is None else with_position(df, order, position)
