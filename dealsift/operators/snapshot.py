"""Snapshots, change history, reviews and keyed writes as joins and aggregates."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealsift import rules
from dealsift.functions import times
from dealsift.functions.text import strings
from dealsift.operators.classify import status_transition
from dealsift.operators.dedupe import latest_per_key
from dealsift.operators.hardware import score_hardware


def with_previous(df: DataFrame, key: str, time: str, order: list[str], values: list[str],
                  bucket: str = "day", name: str = "previous") -> DataFrame:
    """Add the values of the row before, per key in the given order.

    A key's rows are handled in time buckets, so a key with very many rows is not one
    task; only the last row of each bucket travels to the next one.
    """
    sliced = df.withColumn("_bucket", F.date_trunc(bucket, F.col(time)))
    payload = F.struct(*values)
    inside = Window.partitionBy(key, "_bucket").orderBy(time, *order)
    local = sliced.withColumn("_inside", F.lag(payload).over(inside))
    tails = sliced.groupBy(key, "_bucket").agg(F.max_by(payload, F.struct(time, *order)).alias("_tail"))
    across = Window.partitionBy(key).orderBy("_bucket")
    carried = tails.select(key, "_bucket", F.lag("_tail").over(across).alias("_carried"))
    return local.join(carried, [key, "_bucket"], "left").select(
        *df.columns, F.coalesce("_inside", "_carried").alias(name))


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def change_types(previous: Column, pairs: dict[str, list[tuple[Column, Column]]]) -> Column:
    """NEW without a previous row, else the kinds whose columns differ (nulls compare equal)."""
    kinds = []
    for kind, columns in pairs.items():
        differs = F.lit(False)
        for now, before in columns:
            differs = differs | changed(now, before)
        kinds.append(F.when(previous.isNotNull() & differs, F.lit(kind)))
    return strings(F.when(previous.isNull(), F.lit("NEW")), *kinds)


CHANGES = {
    "PRICE_CHANGED": ["total_price", "unit_price", "total_price_usd"],
    "QUANTITY_CHANGED": ["quantity"],
    "STATUS_CHANGED": ["status", "listing_status"],
}


def _compared(columns) -> list[str]:
    return [c for names in CHANGES.values() for c in names if c in columns]


def _pairs(columns, before: str) -> dict:
    return {
        kind: [(F.col(c), F.col(f"{before}.{c}")) for c in names if c in columns]
        for kind, names in CHANGES.items()
    }


def change_history(observations: DataFrame, key: str = "opportunity_key", time: str = "observed_at",
                   order: tuple[str, ...] = ("event_id",), bucket: str = "day") -> DataFrame:
    """Observations that are new or differ from the one before, with their change types."""
    values = _compared(observations.columns)
    seen = with_previous(observations, key, time, list(order), values, bucket)
    typed = seen.withColumn("change_types", change_types(F.col("previous"), _pairs(values, "previous")))
    return typed.filter(F.size("change_types") > 0).drop("previous")


def price_delta(observations: DataFrame, price: str = "total_price_usd", key: str = "opportunity_key",
                time: str = "observed_at", order: tuple[str, ...] = ("event_id",), bucket: str = "day") -> DataFrame:
    """Previous price, absolute and relative change and the price-drop flag per observation."""
    seen = with_previous(observations, key, time, list(order), [price], bucket)
    before, now = F.col(f"previous.{price}"), F.col(price)
    return seen.withColumns({
        "previous_price": before,
        "price_change": now - before,
        "price_change_ratio": F.round(F.try_divide((now - before).cast("double"), before.cast("double")), 4),
        "price_drop": F.coalesce(now < before, F.lit(False)),
    }).drop("previous")


def seen_bounds(observations: DataFrame, key: str = "opportunity_key", time: str = "observed_at",
                order: tuple[str, ...] = ("event_id",), bucket: str = "day") -> DataFrame:
    """First seen, last seen and last changed time per key."""
    values = _compared(observations.columns)
    seen = with_previous(observations, key, time, list(order), values, bucket)
    kinds = change_types(F.col("previous"), _pairs(values, "previous"))
    moved = F.col("previous").isNotNull() & (F.size(kinds) > 0)
    return seen.groupBy(key).agg(
        F.min(time).alias("first_seen_at"), F.max(time).alias("last_seen_at"),
        F.max(F.when(moved, F.col(time))).alias("last_changed_at"))


def snapshot_diff(batch: DataFrame, snapshot: DataFrame, as_of, key: str = "opportunity_key") -> DataFrame:
    """A deduplicated batch against the stored snapshot: change types and seen times."""
    now = times.as_timestamp(as_of)
    values = [c for c in _compared(batch.columns) if c in snapshot.columns]
    carried = [c for c in ("opportunity_id", "first_seen_at", "last_changed_at") if c in snapshot.columns]
    kept = [c for c in batch.columns if c not in ("first_seen_at", "last_seen_at", "last_changed_at", "change_types",
                                                  "opportunity_id")]
    before = snapshot.select(key, F.struct(*dict.fromkeys(values + carried)).alias("_before"))
    joined = batch.join(before, key, "left")
    kinds = change_types(F.col("_before"), _pairs(values, "_before"))
    known = F.col("_before").isNotNull()
    first = F.col("_before.first_seen_at") if "first_seen_at" in carried else F.lit(None).cast("timestamp")
    last_changed = F.col("_before.last_changed_at") if "last_changed_at" in carried else F.lit(None).cast("timestamp")
    identity = F.coalesce(F.col("_before.opportunity_id"), F.sha2(F.col(key), 256)) if (
        "opportunity_id" in carried) else F.sha2(F.col(key), 256)
    return joined.withColumn("change_types", kinds).select(
        *[F.col(c) for c in kept], "change_types",
        identity.alias("opportunity_id"),
        F.coalesce(first, now).alias("first_seen_at"),
        now.alias("last_seen_at"),
        F.when(known & (F.size("change_types") > 0), now).otherwise(last_changed).alias("last_changed_at"),
    )


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], overwrite: list[str], order: tuple[str, ...] = (),
           earliest: tuple[str, ...] = ()) -> DataFrame:
    """New snapshot: insert new keys, and on conflict overwrite only the named columns.

    Both sides hold one row per key.  With ``order`` a stored row is only overwritten by one that is not older in these
    columns, so the result does not depend on how rows were split into batches; ``earliest`` columns keep the lesser value.
    """
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    new = updates.select(*keys, F.struct(*[c for c in updates.columns if c not in keys]).alias("_new"))
    both = old.join(new, keys, "full")
    fresh = F.col("_new").isNotNull()
    if order:
        old_at, new_at = (F.struct(*[F.col(f"{side}.{c}") for c in order]) for side in ("_old", "_new"))
        fresh = fresh & (F.col("_old").isNull() | (new_at >= old_at))
    columns = []
    for name in target.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in earliest and name in updates.columns:
            columns.append(F.least(f"_old.{name}", f"_new.{name}").alias(name))
        elif name not in updates.columns:
            columns.append(F.col(f"_old.{name}"))
        elif name in overwrite:
            columns.append(F.when(fresh, F.col(f"_new.{name}")).otherwise(
                F.col(f"_old.{name}")).alias(name))
        else:
            columns.append(F.when(F.col("_old").isNotNull(), F.col(f"_old.{name}")).otherwise(
                F.col(f"_new.{name}")).alias(name))
    return both.select(*columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the rows whose key it does not hold."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def recheck_candidates(listings: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Listings whose status is worth another look; all of them, or the first ``limit`` in order."""
    due = listings.filter(F.col("listing_status").isin(rules.RECHECK_STATUSES))
    return due if limit is None else due.orderBy(*order).limit(limit)


_MANUAL = ["manual_result", "manual_status", "manual_end_time", "manual_timezone", "manual_notes", "verified_by",
           "verified_at"]


def recheck_merge(existing: DataFrame, fetched: DataFrame, as_of, key: str = "opportunity_key") -> DataFrame:
    """Fetched listings with identity, review fields and attempts of the stored ones, re-scored."""
    carried = [c for c in ["opportunity_id", *_MANUAL] if c in existing.columns]
    before = existing.select(
        key, *[F.col(c).alias(f"_b_{c}") for c in carried], F.col("first_seen_at").alias("_b_first"),
        F.coalesce("status_check_attempts", F.lit(0)).alias("_b_attempts"), F.col("end_time_utc").alias("_b_end"))
    merged = fetched.drop(*carried).join(before, key)
    merged = merged.withColumns({
        **{c: F.col(f"_b_{c}") for c in carried},
        "first_seen_at": F.col("_b_first"),
        "last_seen_at": times.as_timestamp(as_of),
        "status_check_attempts": F.col("_b_attempts") + 1,
    })
    moved = status_transition(merged, as_of, previous_end="_b_end")
    return score_hardware(moved.drop(*[f"_b_{c}" for c in carried], "_b_first", "_b_attempts", "_b_end"))


def manual_overlay(items: DataFrame, reviews: DataFrame, item_key: str = "item_id",
                   order: tuple[str, ...] = ("verified_at", "review_id")) -> DataFrame:
    """Latest review per item overrides status, end time and review flag."""
    latest = latest_per_key(reviews, item_key, list(order))
    names = [c for c in latest.columns if c != item_key]
    joined = items.join(latest.select(item_key, F.struct(*names).alias("_review")), item_key, "left")
    reviewed = F.col("_review").isNotNull()
    status = F.col("_review.manual_status")
    fixes = {
        "manual_status": status, "verified_at": F.col("_review.verified_at"),
        "listing_status": F.coalesce(status, F.col("listing_status")),
        "needs_manual_review": F.when(reviewed, status == "needs_manual_review").otherwise(
            F.col("needs_manual_review") if "needs_manual_review" in items.columns else F.lit(False)),
        "end_time_verification": F.when(reviewed, F.lit("manually_verified")).otherwise(
            F.col("end_time_verification") if "end_time_verification" in items.columns else F.lit("unknown")),
        "status_check_result": F.when(reviewed, F.lit("manual_review_applied")).otherwise(
            F.col("status_check_result") if "status_check_result" in items.columns else F.lit(None)),
    }
    if "end_time_utc" in items.columns and "manual_end_time" in names:
        fixes["end_time_utc"] = F.coalesce(F.col("_review.manual_end_time"), F.col("end_time_utc"))
    return joined.withColumns(fixes).withColumn("final_status", F.col("listing_status")).drop("_review")


def review_overlay(items: DataFrame, reviews: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest review status per item; notes are kept when the review has none."""
    latest = latest_per_key(reviews, key, order).select(
        key, F.col("review_status").alias("_status"), F.col("notes").alias("_notes"))
    joined = items.join(latest, key, "left")
    have = set(items.columns)
    return joined.withColumns({
        "review_status": F.coalesce("_status", "review_status") if "review_status" in have else F.col("_status"),
        "notes": F.coalesce(F.nullif("_notes", F.lit("")), "notes") if "notes" in have else F.col("_notes"),
    }).drop("_status", "_notes")


def struct_overlay(items: DataFrame, reviews: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The latest review of an item as one struct column ``name``; an item without review keeps what it has there."""
    latest = latest_per_key(reviews, key, order)
    found = latest.select(key, F.struct(*[c for c in latest.columns if c != key]).alias("_found"))
    joined = items.join(found, key, "left")
    return joined.withColumn(name, F.coalesce("_found", name) if name in items.columns else F.col("_found")).drop("_found")


def delivery_dedupe(reports: DataFrame, log: DataFrame) -> DataFrame:
    """Reports not yet sent with the same job, type and message hash."""
    keys = ["scan_job_id", "report_type", "message_hash"]
    return reports.join(log.filter(F.col("status") == "sent").select(*keys), keys, "left_anti")


def recent(df: DataFrame, order: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).limit(limit)
