"""First-wins deduplication, top-n and skew helpers.

Groups are never gathered whole: winners come from aggregates with map-side
partial results, or from rank limits that Spark also applies before the shuffle.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def union_sources(*frames: DataFrame, ordinal: str = "source_ord") -> DataFrame:
    """Concatenate source outputs, remembering which source came first."""
    numbered = [f.withColumn(ordinal, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def first_wins(df: DataFrame, keys: list[str], order: list[str], duplicates: str | None = None) -> DataFrame:
    """The first row per key in the given order, optionally with the number of rows dropped for it.

    Without the count, a rank limit of one: every task passes on at most one row per key, and
    columns nobody reads are never computed.  With the count, an aggregate with partial results.
    """
    if duplicates is None:
        return top_n_per_group(df, keys, order, 1, "_place").drop("_place")
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), (F.count(F.lit(1)) - 1).alias(duplicates))
    return picked.select(*keys, "_row.*", duplicates).select(*df.columns, duplicates)


def mark_first(df: DataFrame, keys: list[str], order: list[str], flag: str = "is_first") -> DataFrame:
    """Flag the first row per key.  The order columns must identify a row.

    The flag comes from a join on key and order together, so a key with very many
    rows is spread over all tasks.
    """
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = firsts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(f"_first.{o}").alias(f"_o{i}") for i, o in enumerate(order)],
    )
    same = [df[k].eqNullSafe(firsts[f"_k{i}"]) for i, k in enumerate(keys)]
    same += [df[o].eqNullSafe(firsts[f"_o{i}"]) for i, o in enumerate(order)]
    joined = df.join(firsts.withColumn("_hit", F.lit(True)), reduce(Column.__and__, same), "left")
    return joined.select(*df.columns, F.coalesce("_hit", F.lit(False)).alias(flag))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def top_n_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group.  Spark cuts every group to n rows before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def ranked_per_group(df: DataFrame, keys: list[str], order: list, n: int | None = None, rank: str = "rank") -> DataFrame:
    """Rows with their rank in the group; all of them, or the first ``n``."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def split_outputs(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final, discovery and rejected rows of a frame with a disposition column."""
    kind = F.col("disposition")
    return (
        df.filter(kind == "final"), df.filter(kind == "discovery"),
        df.filter(~kind.isin("final", "discovery")),
    )


def salted_join(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str,
                rows_per_task: int = 200_000, pairs_per_task: int | None = None) -> DataFrame:
    """Inner equi join that splits keys with many rows on both sides.

    Keys above the limit get a grid of (left part, right part) tasks: each left row goes
    to one left part and every right part, and the other way round.  Every pair meets once.
    The part of a row is a hash of its id, so a recomputed task sends it the same way.

    With ``pairs_per_task`` rows and pairs are counted per key first, and the join gets tasks for about so many pairs each:
    small inputs may meet in very many pairs, and Spark sizes tasks by their input.  Where no key has too many rows, none
    is split, and no side is read again to find out.
    """
    parts = None
    if pairs_per_task is not None:
        spark = left.sparkSession
        sizes = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_n"), (right, "_m"))]
        pairs, most = sizes[0].join(sizes[1], on).agg(
            F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0)), F.coalesce(F.greatest(F.max("_n"), F.max("_m")), F.lit(0))).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // pairs_per_task))
        if most <= rows_per_task:
            return left.repartition(parts, *on).join(right.repartition(parts, *on), on)

    def hot_keys(df: DataFrame, parts: str) -> DataFrame:
        counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
        return counted.select(*on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(parts))

    hot = hot_keys(left, "_lp").join(hot_keys(right, "_rp"), on, "full").select(
        *on, F.coalesce("_lp", F.lit(1)).alias("_lp"), F.coalesce("_rp", F.lit(1)).alias("_rp"))

    def spread(df: DataFrame, row_id: str, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        marked = df.join(hot, on, "left")
        own_count, other_count = F.coalesce(own_parts, F.lit(1)), F.coalesce(other_parts, F.lit(1))
        salt = F.pmod(F.xxhash64(row_id), own_count)
        return (
            marked.withColumn(own, salt.cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_count - 1)))
            .drop("_lp", "_rp")
        )

    salted_left = spread(left, left_id, "_ls", "_lp", "_rs", "_rp")
    salted_right = spread(right, right_id, "_rs", "_rp", "_ls", "_lp")
    keys = [*on, "_ls", "_rs"]
    if parts is not None:
        salted_left, salted_right = salted_left.repartition(parts, *keys), salted_right.repartition(parts, *keys)
    return salted_left.join(salted_right, keys).drop("_ls", "_rs")
