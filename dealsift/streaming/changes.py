"""Change detection and status aging: micro-batches against stored state, without Python on executors."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from dealsift.functions import times
from dealsift.operators.dedupe import latest_per_key
from dealsift.operators.snapshot import CHANGES, change_types, with_previous
from dealsift.sources.tables import read_snapshot, write_snapshot

def stream_change_detection(state_root: str, changes_root: str, key: str = "opportunity_key", time: str = "observed_at",
                            order: tuple[str, ...] = ("event_id",), bucket: str = "day") -> Callable:
    """Batch handler for ``foreachBatch``: append the rows that are new or differ from the one before, with their change types.

    Rows of a micro-batch are compared among themselves by ``with_previous``, in time buckets and inside the JVM, however
    many a key has. State holds the last compared values of a key: the first row of a key in the batch is compared with
    it, the last one replaces it, so one row a key and batch meets the state. Both writes go to places named by the batch
    number; a repeated batch leaves the same tables. Batches that follow each other in time give the rows of a single one.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        values = [c for names in CHANGES.values() for c in names if c in batch.columns]
        last = latest_per_key(batch.select(key, time, *order, *values), key, [time, *order]).select(key, F.struct(*values).alias("_last"))
        before = read_snapshot(batch.sparkSession, state_root, before=batch_id)
        seen = source = with_previous(batch, key, time, list(order), values, bucket, name="_previous").persist()
        if before is not None:
            # rows with a row before them in the batch need no state
            firsts = seen.filter(F.col("_previous").isNull()).drop("_previous").join(before.withColumnRenamed("_last", "_previous"), key, "left")
            seen = seen.filter(F.col("_previous").isNotNull()).unionByName(firsts)
            last = last.unionByName(before.join(last, key, "left_anti"))
        pairs = {kind: [(F.col(c), F.col(f"_previous.{c}")) for c in names if c in values] for kind, names in CHANGES.items()}
        typed = seen.withColumn("change_types", change_types(F.col("_previous"), pairs)).drop("_previous")
        typed.filter(F.size("change_types") > 0).write.mode("overwrite").parquet(f"{changes_root}/batch={batch_id}")
        write_snapshot(last, state_root, batch_id)
        source.unpersist()

    return handle


def _due(row: str) -> Column:
    """Moves that time alone causes after an observation: when each is due, when it takes effect, and to which status."""
    def at(name: str) -> Column:
        return F.col(f"{row}.{name}")

    def move(due: Column, status: str) -> Column:
        return F.struct(due.alias("moved_at"), F.greatest(due, at("seen")).alias("effective"), F.lit(status).alias("listing_status"))

    end, status = at("end"), at("status")
    dated = end.isNotNull() & status.isin("active", "ending_soon", "unknown")
    return F.array_compact(F.array(
        F.when(dated & (status != "ending_soon"), move(times.plus_hours(end, -24), "ending_soon")), F.when(dated, move(end, "ended")),
        F.when(end.isNull() & (status == "unknown"), move(times.plus_hours(at("seen"), 48), "needs_manual_review"))))


def stream_status_aging(state_root: str, moves_root: str, lateness: str = "1 hour", key: str = "opportunity_key", time: str = "observed_at",
                        order: str = "event_id", bucket: str = "day") -> Callable:
    """Batch handler for ``foreachBatch``: append the status moves that time alone causes.

    A listing moves to ending soon a day before its end, to ended at the end, and an unknown one without an end to review
    after 48 hours, unless a later observation comes first. ``moved_at`` is the due time. A move is settled once the
    watermark (latest time less the lateness) has reached it, so it depends on event times alone: one batch and many give
    the same rows. State holds the observations above the watermark and the last one below it of each key. Rows of a
    batch are compared in time buckets in the JVM, however many a key has. Rows at or below the watermark of the batch
    before are late and dropped.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, F.col(time).alias("seen"), F.col(order).alias("tie"), F.col("listing_status").alias("status"), F.col("end_time_utc").alias("end"))
        state, marks = read_snapshot(spark, f"{state_root}/rows", before=batch_id), read_snapshot(spark, f"{state_root}/mark", before=batch_id)
        below = marks.first()["mark"] if marks is not None else None
        if below is not None:
            rows = rows.filter(F.col("seen") > F.lit(below)).unionByName(state)
        rows = rows.persist()
        mark = rows.agg((F.max("seen") - F.expr(f"INTERVAL {lateness}")).alias("mark")).first()["mark"]
        mark = mark if below is None or (mark is not None and mark > below) else below
        reached = F.lit(mark).cast("timestamp")
        values = ["seen", "status", "end"]
        followed = with_previous(rows, key, "seen", ["tie"], values, bucket, name="_row").filter(F.col("_row").isNotNull())
        last = latest_per_key(rows, key, ["seen", "tie"]).select(key, F.struct(*values).alias("_row"), F.lit(None).cast("timestamp").alias("_until"))
        each = followed.select(key, "_row", F.col("seen").alias("_until")).unionByName(last)
        moves = each.select(key, "_until", F.inline(_due("_row"))).filter(
            (F.col("effective") <= reached) & (F.col("_until").isNull() | (F.col("effective") < F.col("_until"))))
        if below is not None:
            moves = moves.filter(F.col("effective") > F.lit(below))
        moves.select(key, "moved_at", "listing_status").write.mode("overwrite").parquet(f"{moves_root}/batch={batch_id}")
        settled = latest_per_key(rows.filter(F.col("seen") <= reached), key, ["seen", "tie"])
        write_snapshot(rows.filter(F.col("seen") > reached).unionByName(settled.select(*rows.columns)), f"{state_root}/rows", batch_id)
        write_snapshot(spark.range(1).select(reached.alias("mark")), f"{state_root}/mark", batch_id)
        rows.unpersist()

    return handle
