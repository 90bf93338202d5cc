"""Queries over observations, snapshots, reviews, runs and reports."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog import hardware as H
from dealsift.catalog.records import cte, record
from dealsift.catalog.registry import AS_OF, EVENT_AS_OF, flags, in_list, joined, joined_sql, q, query, stamp, stamp_sql
from dealsift.functions import times
from dealsift.operators import classify, dedupe, funnel, lifecycle, report, snapshot
from dealsift.plans import scans
from dealsift.schemas import legacy_defaults
from dealsift.session import shared_folder
from dealsift.sources import tables

NOW = f"TIMESTAMP '{EVENT_AS_OF}'"
_OBS = f"WITH {cte('observation')}"
_LAG = f"""{_OBS}, seen AS (SELECT *, lag(total_price_usd) OVER w AS p_price, lag(quantity) OVER w AS p_quantity, lag(listing_status) OVER w AS p_status,
  row_number() OVER w AS rn FROM observation WINDOW w AS (PARTITION BY opportunity_key ORDER BY observed_at, event_id))"""
_KINDS = flags([("rn = 1", "NEW"), ("rn > 1 AND total_price_usd IS DISTINCT FROM p_price", "PRICE_CHANGED"),
                ("rn > 1 AND quantity IS DISTINCT FROM p_quantity", "QUANTITY_CHANGED"),
                ("rn > 1 AND listing_status IS DISTINCT FROM p_status", "STATUS_CHANGED")])
_TRACK = f"WITH {cte('tracked')}"
_LATEST = f"latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_key ORDER BY observed_at DESC, event_id DESC) AS rn FROM tracked) WHERE rn = 1)"


def obs(spark, sf) -> DataFrame:
    return record(spark, sf, "observation")


def tracked(spark, sf) -> DataFrame:
    return record(spark, sf, "tracked")


@query("change_history", f"{_LAG} SELECT opportunity_key, event_id, total_price_usd, quantity, listing_status, {joined_sql(_KINDS)} AS change_types FROM seen WHERE len({_KINDS}) > 0")
def _(spark, sf):
    return snapshot.change_history(obs(spark, sf)).select(
        "opportunity_key", "event_id", "total_price_usd", "quantity", "listing_status", joined("change_types"))


@query("price_delta", f"""{_LAG} SELECT opportunity_key, event_id, p_price AS previous_price, total_price_usd - p_price AS price_change,
  round(CASE WHEN p_price <> 0 THEN cast(total_price_usd - p_price AS double) / p_price END, 4) AS price_change_ratio, coalesce(total_price_usd < p_price, false) AS price_drop FROM seen""")
def _(spark, sf):
    return snapshot.price_delta(obs(spark, sf)).select(
        "opportunity_key", "event_id", "previous_price", "price_change", "price_change_ratio", "price_drop")


@query("seen_bounds", f"""{_LAG} SELECT opportunity_key, {stamp_sql('min(observed_at)')} AS first_seen_at, {stamp_sql('max(observed_at)')} AS last_seen_at,
  {stamp_sql(f'max(CASE WHEN rn > 1 AND len({_KINDS}) > 0 THEN observed_at END)')} AS last_changed_at FROM seen GROUP BY opportunity_key""")
def _(spark, sf):
    return snapshot.seen_bounds(obs(spark, sf)).select(
        "opportunity_key", stamp("first_seen_at"), stamp("last_seen_at"), stamp("last_changed_at"))


@query("latest_per_key", f"""{_OBS} SELECT opportunity_key, event_id, total_price_usd, listing_status FROM (SELECT *, row_number() OVER
  (PARTITION BY opportunity_key ORDER BY observed_at DESC, event_id DESC) AS rn FROM observation) WHERE rn = 1""")
def _(spark, sf):
    return dedupe.latest_per_key(obs(spark, sf), "opportunity_key", ["observed_at", "event_id"]).select(
        "opportunity_key", "event_id", "total_price_usd", "listing_status")


_CUT = "TIMESTAMP '2024-01-05 00:00:00'"
_OLD_NEW = f"""{_OBS}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_key ORDER BY observed_at DESC, event_id DESC) AS rn FROM observation WHERE observed_at < {_CUT}) WHERE rn = 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_key ORDER BY observed_at DESC, event_id DESC) AS rn FROM observation WHERE observed_at >= {_CUT}) WHERE rn = 1)"""


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = obs(spark, sf)
    cut = F.lit("2024-01-05 00:00:00").cast("timestamp")
    order = ["observed_at", "event_id"]
    return (
        dedupe.latest_per_key(rows.filter(F.col("observed_at") < cut), "opportunity_key", order),
        dedupe.latest_per_key(rows.filter(F.col("observed_at") >= cut), "opportunity_key", order))


_DIFF = flags([("o.opportunity_key IS NULL", "NEW"), ("o.opportunity_key IS NOT NULL AND n.total_price_usd IS DISTINCT FROM o.total_price_usd", "PRICE_CHANGED"),
               ("o.opportunity_key IS NOT NULL AND n.quantity IS DISTINCT FROM o.quantity", "QUANTITY_CHANGED"),
               ("o.opportunity_key IS NOT NULL AND n.listing_status IS DISTINCT FROM o.listing_status", "STATUS_CHANGED")])


@query("snapshot_diff", f"""{_OLD_NEW} SELECT n.opportunity_key, n.total_price_usd, sha256(n.opportunity_key) AS opportunity_id, {joined_sql(_DIFF)} AS change_types,
  {stamp_sql(f'coalesce(o.observed_at, {NOW})')} AS first_seen_at, {stamp_sql(NOW)} AS last_seen_at,
  CASE WHEN o.opportunity_key IS NOT NULL AND len({_DIFF}) > 0 THEN {stamp_sql(NOW)} END AS last_changed_at
FROM new n LEFT JOIN old o USING (opportunity_key)""")
def _(spark, sf):
    old, new = _old_new(spark, sf)
    known = old.withColumn("first_seen_at", F.col("observed_at"))
    return snapshot.snapshot_diff(new, known, EVENT_AS_OF).select(
        "opportunity_key", "total_price_usd", "opportunity_id", joined("change_types"), stamp("first_seen_at"), stamp("last_seen_at"), stamp("last_changed_at"))


_UPSERT = f"""{_OLD_NEW} SELECT coalesce(n.opportunity_key, o.opportunity_key) AS opportunity_key,
  CASE WHEN n.opportunity_key IS NOT NULL THEN n.total_price_usd ELSE o.total_price_usd END AS total_price_usd,
  CASE WHEN n.opportunity_key IS NOT NULL THEN n.listing_status ELSE o.listing_status END AS listing_status,
  CASE WHEN o.opportunity_key IS NOT NULL THEN o.event_id ELSE n.event_id END AS event_id FROM old o FULL JOIN new n ON o.opportunity_key = n.opportunity_key"""


@query("upsert_sink", _UPSERT)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    root = shared_folder(spark, "upsert")
    overwrite = ["total_price_usd", "listing_status"]
    tables.write_snapshot(old, root, 0)
    tables.upsert_sink(new, root, ["opportunity_key"], overwrite, 1)
    tables.upsert_sink(new, root, ["opportunity_key"], overwrite, 2)
    return tables.read_snapshot(spark, root).select("opportunity_key", "total_price_usd", "listing_status", "event_id")


@query("insert_if_absent", f"""{_OLD_NEW} SELECT opportunity_key, event_id FROM old UNION ALL
SELECT n.opportunity_key, n.event_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.opportunity_key = n.opportunity_key)""")
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return snapshot.insert_if_absent(old, new, ["opportunity_key"]).select("opportunity_key", "event_id")


@query("history_append", f"{_OBS} SELECT event_id, opportunity_key, total_price_usd, strftime(observed_at, '%Y-%m-%d') AS observed_date FROM observation")
def _(spark, sf):
    root = shared_folder(spark, "history")
    rows = obs(spark, sf)
    cut = F.lit("2024-01-05 00:00:00").cast("timestamp")
    tables.history_append(rows.filter(F.col("observed_at") < cut), root, batch=0)
    tables.history_append(rows.filter(F.col("observed_at") >= cut), root, batch=1)
    return spark.read.parquet(root).select("event_id", "opportunity_key", "total_price_usd", F.col("observed_date").cast("string").alias("observed_date"))


@query("recent_scan", f"WITH {cte('manual_review')} SELECT review_id, item_id, manual_status FROM manual_review ORDER BY verified_at DESC, review_id DESC LIMIT 50")
def _(spark, sf):
    return snapshot.recent(record(spark, sf, "manual_review"), "verified_at", "review_id", 50).select("review_id", "item_id", "manual_status")


# ---------------------------------------------------------------- status rules

_REF = "coalesce(last_status_check_at, first_seen_at)"
_MOVED = f"""CASE WHEN end_time_utc <= {NOW} THEN 'ended' WHEN end_time_utc <= {NOW} + INTERVAL 24 HOUR THEN 'ending_soon'
  WHEN end_time_utc > {NOW} AND listing_status IN ('ended', 'sold', 'unknown', 'needs_manual_review') THEN 'active'
  WHEN end_time_utc IS NULL AND listing_status = 'unavailable' THEN 'needs_manual_review'
  WHEN end_time_utc IS NULL AND listing_status = 'unknown' AND {_REF} < {NOW} - INTERVAL 48 HOUR THEN 'needs_manual_review' ELSE listing_status END"""
_RESULT = f"""CASE WHEN end_time_utc <= {NOW} THEN CASE WHEN listing_status IN ('active', 'ending_soon') THEN 'active_text_but_end_time_elapsed' END
  WHEN end_time_utc <= {NOW} + INTERVAL 24 HOUR THEN NULL
  WHEN end_time_utc > {NOW} AND listing_status IN ('ended', 'sold', 'unknown', 'needs_manual_review') THEN 'future_end_time_overrode_page_template_status'
  WHEN end_time_utc IS NULL AND listing_status = 'unavailable' THEN 'detail_page_blocked_or_unavailable'
  WHEN end_time_utc IS NULL AND listing_status = 'unknown' AND {_REF} < {NOW} - INTERVAL 48 HOUR THEN 'unknown_older_than_48h' END"""


@query("status_transition", f"""{_TRACK}, moved AS (SELECT *, {_MOVED} AS new_status, {_RESULT} AS result FROM tracked)
SELECT event_id, new_status AS listing_status, CASE WHEN end_time_utc <= {NOW} AND listing_status IN ('active', 'ending_soon') THEN 'conflicting' END AS end_time_verification,
  result AS status_check_result, needs_manual_review OR new_status = 'needs_manual_review' AS needs_manual_review FROM moved""")
def _(spark, sf):
    return classify.status_transition(tracked(spark, sf), EVENT_AS_OF).select(
        "event_id", "listing_status", "end_time_verification", "status_check_result", "needs_manual_review")


_CHECKED = "coalesce(last_status_check_at, first_seen_at)"


@query("next_check_at", f"""{_TRACK} SELECT event_id, {stamp_sql(f'''CASE WHEN listing_status IN ('ended', 'sold', 'removed') THEN {_CHECKED} + INTERVAL 168 HOUR
  WHEN listing_status = 'ending_soon' THEN {_CHECKED} + INTERVAL 1 HOUR
  WHEN listing_status = 'active' AND end_time_utc <= {_CHECKED} + INTERVAL 72 HOUR THEN {_CHECKED} + INTERVAL 6 HOUR
  WHEN listing_status = 'unknown' THEN {_CHECKED} + INTERVAL 12 HOUR
  WHEN listing_status = 'needs_manual_review' AND status_check_attempts >= 3 THEN NULL ELSE {_CHECKED} + INTERVAL 24 HOUR END''')} AS next_status_check_at FROM tracked""")
def _(spark, sf):
    checked = F.coalesce("last_status_check_at", "first_seen_at")
    at = times.next_check_at(F.col("listing_status"), F.col("end_time_utc"), checked, F.col("status_check_attempts"))
    return tracked(spark, sf).select("event_id", stamp(at, "next_status_check_at"))


_CURRENT = f"(listing_status IN ('active', 'ending_soon') OR (listing_status = 'unknown' AND {_REF} >= {NOW} - INTERVAL 24 HOUR))"
_REVIEW = f"(listing_status = 'needs_manual_review' OR needs_manual_review OR (listing_status = 'unknown' AND {_REF} < {NOW} - INTERVAL 24 HOUR))"
_DEAD = f"listing_status IN {in_list(rules.DEAD_STATUSES)}"


@query("lifecycle_partition", f"{_TRACK} " + " UNION ALL ".join(
    f"SELECT '{n}' AS part, event_id FROM tracked WHERE {c}" for n, c in (("current", _CURRENT), ("review", _REVIEW), ("history", _DEAD))))
def _(spark, sf):
    parts = lifecycle.lifecycle_partition(tracked(spark, sf), EVENT_AS_OF)
    named = [p.select(F.lit(n).alias("part"), "event_id") for n, p in zip(("current", "review", "history"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("report_eligible", f"""{_TRACK} SELECT event_id, listing_status FROM tracked WHERE listing_status IN ('active', 'ending_soon')
  OR (listing_status = 'unknown' AND NOT needs_manual_review AND {_REF} >= {NOW} - INTERVAL 48 HOUR)""")
def _(spark, sf):
    return lifecycle.report_eligible(tracked(spark, sf), EVENT_AS_OF).select("event_id", "listing_status")


@query("recheck_candidates", f"{_TRACK} SELECT event_id, listing_status FROM tracked WHERE listing_status IN {in_list(rules.RECHECK_STATUSES)}")
def _(spark, sf):
    return snapshot.recheck_candidates(tracked(spark, sf), ["observed_at", "event_id"]).select("event_id", "listing_status")


@query("time_left", f"""{_TRACK} SELECT event_id, CASE WHEN end_time_utc IS NULL THEN 'Unknown' WHEN end_time_utc <= {NOW} THEN 'Ended' ELSE
  cast(epoch_us(end_time_utc - {NOW}) // 3600000000 AS varchar) || 'h ' || cast((epoch_us(end_time_utc - {NOW}) % 3600000000) // 60000000 AS varchar) || 'm' END AS time_left FROM tracked""".replace(
        "epoch_us(end_time_utc - " + NOW + ")", "(epoch_us(end_time_utc) - epoch_us(" + NOW + "))"))
def _(spark, sf):
    left = times.time_left(F.col("end_time_utc"), times.as_timestamp(EVENT_AS_OF))
    return tracked(spark, sf).select("event_id", left.alias("time_left"))


# ---------------------------------------------------------------- rechecks

def _recheck_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Stored listings, and the same listings fetched again (every fourth one with another status)."""
    stored = dedupe.latest_per_key(tracked(spark, sf), "opportunity_key", ["observed_at", "event_id"])
    flip = F.col("event_id") % 4 == 0
    spec = {
        "title": "string", "model": "string", "category": "string", "condition": "string", "seller_type": "string", "location_state": "string",
        "confidence_level": "string", "component_completeness": "string", "buyer_premium": "string"}
    fetched = stored.select(
        "opportunity_key", "event_id", F.when(flip, F.lit("unavailable")).otherwise(F.col("listing_status")).alias("listing_status"),
        F.when(~flip, F.col("end_time_utc")).alias("end_time_utc"), F.col("last_status_check_at"), F.col("needs_manual_review"),
        F.lit(None).cast("string").alias("end_time_verification"), F.lit(None).cast("string").alias("status_check_result"),
        F.col("total_price_usd").cast("double").alias("total_price"), F.col("total_price_usd").cast("double").alias("current_price"),
        F.col("total_price_usd").cast("double").alias("current_total_cost"), F.lit(None).cast("double").alias("unit_price"),
        F.lit(None).cast("double").alias("cost_per_unit"), F.col("quantity").cast("bigint").alias("quantity"),
        F.lit(None).cast("boolean").alias("pickup_only"), F.lit(None).cast("boolean").alias("shipping_available"),
        F.array().cast("array<string>").alias("risk_flags"), *[F.lit("unknown" if k != "model" else None).cast(v).alias(k) for k, v in spec.items()])
    return stored, fetched


_RECHECK = f"""{_TRACK}, {_LATEST}, again AS (SELECT * REPLACE (CASE WHEN event_id % 4 = 0 THEN 'unavailable' ELSE listing_status END AS listing_status,
    CASE WHEN event_id % 4 <> 0 THEN end_time_utc END AS end_time_utc), end_time_utc AS before_end, listing_status AS before_status FROM latest),
moved AS (SELECT *, CASE WHEN end_time_utc IS NULL AND listing_status = 'unavailable' AND before_end <= {NOW} THEN 'ended' ELSE {_MOVED} END AS new_status FROM again)"""
_DUE = f"before_status IN {in_list(rules.RECHECK_STATUSES)}"


@query("recheck_merge", f"""{_RECHECK} SELECT opportunity_key, new_status AS listing_status, status_check_attempts + 1 AS status_check_attempts,
  {stamp_sql('first_seen_at')} AS first_seen_at, CASE WHEN new_status = 'unavailable' THEN 'expired' WHEN new_status IN ('ended', 'sold', 'removed') THEN 'expired' END AS expired FROM moved""")
def _(spark, sf):
    stored, fetched = _recheck_inputs(spark, sf)
    merged = snapshot.recheck_merge(stored, fetched, EVENT_AS_OF)
    return merged.select("opportunity_key", "listing_status", "status_check_attempts", stamp("first_seen_at"),
                         F.when(F.col("recommendation") == "expired", F.col("recommendation")).alias("expired"))


_SUMMARY = f"""count(*) AS checked, count(*) FILTER (new_status = 'active') AS auto_active, count(*) FILTER (new_status = 'ended') AS auto_ended,
  count(*) FILTER (new_status = 'ending_soon') AS ending_soon, count(*) FILTER (new_status = 'needs_manual_review') AS needs_manual_review,
  count(*) FILTER (end_time_utc <= {NOW} AND listing_status IN ('active', 'ending_soon')) AS conflicting, 0 AS errors"""


@query("recheck_summary", f"{_RECHECK} SELECT {_SUMMARY} FROM moved WHERE {_DUE}")
def _(spark, sf):
    stored, fetched = _recheck_inputs(spark, sf)
    return funnel.recheck_summary(scans.bulk_recheck(stored, fetched, EVENT_AS_OF, ["observed_at"], limit=None))


@query("bulk_recheck", f"""{_RECHECK} SELECT opportunity_key, new_status AS listing_status FROM (SELECT * FROM moved WHERE {_DUE} )""")
def _(spark, sf):
    stored, fetched = _recheck_inputs(spark, sf)
    return scans.bulk_recheck(stored, fetched, EVENT_AS_OF, ["observed_at", "event_id"]).select("opportunity_key", "listing_status")


# ---------------------------------------------------------------- reviews and deliveries

@query("manual_overlay", f"""WITH {cte('manual_review')}, item AS (SELECT c_custkey AS item_id, CASE c_custkey % 3 WHEN 0 THEN 'unknown' ELSE 'active' END AS listing_status FROM customer),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY verified_at DESC, review_id DESC) AS rn FROM manual_review) WHERE rn = 1)
SELECT i.item_id, coalesce(manual_status, i.listing_status) AS listing_status, coalesce(manual_status = 'needs_manual_review', false) AS needs_manual_review,
  CASE WHEN manual_status IS NOT NULL THEN 'manually_verified' ELSE 'unknown' END AS end_time_verification, {stamp_sql('verified_at')} AS verified_at
FROM item i LEFT JOIN latest l ON l.item_id = i.item_id""")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 3 == 0, "unknown").otherwise("active").alias("listing_status"))
    return snapshot.manual_overlay(items, record(spark, sf, "manual_review")).select(
        "item_id", "listing_status", "needs_manual_review", "end_time_verification", stamp("verified_at"))


_SITE_REVIEWS = """SELECT o_orderkey AS review_id, o_custkey AS site_id, cast(o_orderdate AS timestamp) AS reviewed_at,
  CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'rejected' ELSE 'watch' END AS review_status, cast(NULL AS varchar(20)) AS notes, o_orderpriority AS verdict FROM {orders}"""
_SUPPLIER_REVIEWS = """SELECT l_orderkey * 10 + l_linenumber AS review_id, l_suppkey AS supplier_id, cast(l_shipdate AS timestamp) AS reviewed_at,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'watch' END AS review_status,
  CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('note ', cast(l_orderkey AS varchar(20))) END AS notes FROM {lineitem}"""


def _latest_sql(reviews: str, key: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY reviewed_at DESC, review_id DESC) AS rn FROM ({reviews})) WHERE rn = 1"


@query("site_review", f"""WITH latest AS ({_latest_sql(_SITE_REVIEWS.format(orders='orders'), 'site_id')})
SELECT c_custkey AS site_id, coalesce(l.review_status, 'needs_review') AS review_status, CASE WHEN l.site_id IS NOT NULL THEN verdict END AS verdict, {stamp_sql('reviewed_at')} AS reviewed_at FROM customer LEFT JOIN latest l ON l.site_id = c_custkey""")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("site_id"), F.lit("needs_review").alias("review_status"))
    reviews = spark.sql(_SITE_REVIEWS, orders=spark.read.parquet(f"{sf}/orders.parquet"))
    order = ["reviewed_at", "review_id"]
    reviewed = snapshot.review_overlay(items, reviews, "site_id", order)
    verified = snapshot.struct_overlay(reviewed, reviews.select("site_id", "verdict", *order), "site_id", order, "data_truth_verification")
    return verified.select("site_id", "review_status", "data_truth_verification.verdict", stamp("data_truth_verification.reviewed_at", "reviewed_at"))


@query("supplier_review", f"""WITH latest AS ({_latest_sql(_SUPPLIER_REVIEWS.format(lineitem='lineitem'), 'supplier_id')})
SELECT s_suppkey AS supplier_id, coalesce(l.review_status, 'needs_review') AS review_status, coalesce(nullif(l.notes, ''), CASE WHEN s_suppkey % 3 > 0 THEN s_name END) AS notes FROM supplier LEFT JOIN latest l ON l.supplier_id = s_suppkey""")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("supplier_id"), F.lit("needs_review").alias("review_status"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("notes"))
    reviews = spark.sql(_SUPPLIER_REVIEWS, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return snapshot.review_overlay(items, reviews, "supplier_id", ["reviewed_at", "review_id"]).select("supplier_id", "review_status", "notes")


_REPORTS = "SELECT item_id AS scan_job_id, 'daily' AS report_type, sha256(manual_status || cast(item_id AS varchar)) AS message_hash, review_id FROM manual_review"


@query("delivery_dedupe", f"""WITH {cte('manual_review')}, reports AS ({_REPORTS}), log AS (SELECT *, CASE WHEN review_id % 3 = 0 THEN 'sent' ELSE 'failed' END AS status FROM reports WHERE review_id % 2 = 0)
SELECT scan_job_id, message_hash, review_id FROM reports r WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.status = 'sent' AND l.scan_job_id = r.scan_job_id AND l.report_type = r.report_type AND l.message_hash = r.message_hash)""")
def _(spark, sf):
    reviews = record(spark, sf, "manual_review")
    reports = reviews.select(
        F.col("item_id").alias("scan_job_id"), F.lit("daily").alias("report_type"),
        report.message_hash(F.concat("manual_status", F.col("item_id").cast("string"))).alias("message_hash"), "review_id")
    log = reports.filter(F.col("review_id") % 2 == 0).withColumn("status", F.when(F.col("review_id") % 3 == 0, "sent").otherwise("failed"))
    return snapshot.delivery_dedupe(reports, log).select("scan_job_id", "message_hash", "review_id")


@query("legacy_defaults", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS flag_count, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS detail_count,
  CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'active' END AS final_status, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'high' END AS cost_confidence FROM events""")
def _(spark, sf):
    e, c = F.col("event_id"), F.col
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.when(e % 2 == 1, F.array("event_type")).alias("risk_flags"), F.when(e % 3 != 0, F.create_map(F.lit("k"), c("event_type"))).alias("component_details"),
        F.when(e % 5 == 0, c("event_type")).alias("final_status"), F.when(e % 7 != 0, F.lit("active")).alias("listing_status"),
        F.when(e % 2 == 1, F.lit("high")).alias("cost_confidence"))
    return legacy_defaults(rows).select("event_id", F.size("risk_flags").alias("flag_count"), F.size("component_details").alias("detail_count"), "final_status", "cost_confidence")


# ---------------------------------------------------------------- counters

@query("source_run_summary", f"""WITH {cte('source_run')} SELECT source_name, count(*) FILTER (status IN ('failed', 'timeout', 'blocked')) AS failed,
  count(*) FILTER (status = 'success' AND result_count = 0) AS zero, count(*) FILTER (status = 'success' AND result_count <> 0) AS successful FROM source_run GROUP BY source_name""")
def _(spark, sf):
    return funnel.source_run_summary(record(spark, sf, "source_run"), ("source_name",))


@query("executed_query_counts", f"""WITH {cte('source_run')} SELECT source_name, query, count(*) AS run_count, sum(CASE WHEN status = 'success' THEN result_count ELSE 0 END)::BIGINT AS result_count,
  count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'timeout') AS timeout_count, count(*) FILTER (status = 'failed') AS failed_count,
  count(*) FILTER (status = 'blocked') AS blocked_count FROM source_run GROUP BY source_name, query""")
def _(spark, sf):
    return funnel.executed_query_counts(record(spark, sf, "source_run"))


@query("source_health", f"""WITH {cte('source_run')}, ok AS (SELECT source_name, max((completed_at, run_id)) FILTER (status = 'success') AS last_ok, max(completed_at) FILTER (status = 'success') AS last_success_at,
  max(completed_at) AS last_checked_at, arg_max(status, (completed_at, run_id)) FILTER (status <> 'success') AS last_error FROM source_run GROUP BY source_name)
SELECT source_name, {stamp_sql('last_success_at')} AS last_success_at, last_error, {stamp_sql('last_checked_at')} AS last_checked_at,
  (SELECT count(*) FROM source_run r WHERE r.source_name = ok.source_name AND r.status <> 'success' AND (ok.last_ok IS NULL OR (r.completed_at, r.run_id) > ok.last_ok)) AS consecutive_failures FROM ok""")
def _(spark, sf):
    return funnel.source_health(record(spark, sf, "source_run")).select(
        "source_name", stamp("last_success_at"), "last_error", stamp("last_checked_at"), "consecutive_failures")


_FUNNEL = {
    "raw_results": "(SELECT count(*) FROM paged)", **{
        m: f"(SELECT count(*) FROM paged WHERE page_type = '{k}')" for m, k in (
            ("specific_listings", "specific_listing"), ("listing_collections", "listing_collection"), ("source_pages", "source_page"),
            ("news_or_articles", "news_or_article"), ("irrelevant", "irrelevant"))},
    "normalized_listings": "(SELECT count(*) FROM norm WHERE page_type = 'specific_listing')",
    "duplicates_removed": "(SELECT count(*) - count(DISTINCT opportunity_key) FROM norm WHERE page_type = 'specific_listing')",
    "new_opportunities": "(SELECT count(*) FROM scored WHERE listing_status = 'active')", "changed_opportunities": "0", "price_changes": "0",
    "quantity_changes": "0", "status_changes": "0", "active_opportunities": "(SELECT count(*) FROM scored WHERE listing_status = 'active')", "ending_soon": "0",
    "expired_removed": "(SELECT count(*) FROM scored WHERE dead)", "unavailable_links": "0",
    "needs_manual_review": "(SELECT count(*) FROM scored WHERE listing_status = 'needs_manual_review' OR needs_manual_review)",
    "final_opportunities": "(SELECT count(*) FROM scored WHERE listing_status = 'active')",
    "high_score_opportunities": "(SELECT count(*) FROM scored WHERE listing_status = 'active' AND opportunity_score >= 60)",
    "failed_sources": "(SELECT count(*) FROM events WHERE value < 40)",
}


@query("hardware_funnel", f"{H._UNIQUE} " + " UNION ALL ".join(f"SELECT {q(m)} AS metric, {e} AS value" for m, e in _FUNNEL.items()))
def _(spark, sf):
    scan = scans.hardware_scan(H.hits_of(spark, sf), AS_OF, H.ORDER)
    return scan.funnel(record(spark, sf, "source_run"))


@query("dashboard_rollup", f"""{H._UNIQUE}, key AS (SELECT *, opportunity_key AS k FROM scored)
SELECT 'top' AS list_name, k AS opportunity_key, risk_score FROM (SELECT * FROM key WHERE listing_status = 'active' ORDER BY opportunity_score DESC, risk_score, k LIMIT 20)
UNION ALL SELECT 'history', k, risk_score FROM (SELECT * FROM key WHERE dead ORDER BY observed_at DESC, k LIMIT 80)
UNION ALL SELECT 'needs_review', k, risk_score FROM (SELECT * FROM key WHERE listing_status = 'needs_manual_review' OR needs_manual_review ORDER BY observed_at DESC, k LIMIT 80)
UNION ALL SELECT 'total_seen', cast(count(*) AS varchar), NULL FROM key UNION ALL SELECT 'total_active', cast(count(*) AS varchar), NULL FROM key WHERE listing_status = 'active'
UNION ALL SELECT 'total_history', cast(count(*) AS varchar), NULL FROM key WHERE dead
UNION ALL SELECT 'total_review', cast(count(*) AS varchar), NULL FROM key WHERE listing_status = 'needs_manual_review' OR needs_manual_review""")
def _(spark, sf):
    scan = scans.hardware_scan(H.hits_of(spark, sf), AS_OF, H.ORDER)
    # lists and totals read the same listings: work them out once, with the columns either reads
    folder = shared_folder(spark, "dashboard")
    tables.write_snapshot(scan.listings.withColumn("last_seen_at", F.col("observed_at")).select(
        "opportunity_key", "listing_status", "needs_manual_review", "last_status_check_at", "first_seen_at", "last_seen_at", "opportunity_score", "risk_score"), folder, 0)
    rows = tables.read_snapshot(spark, folder)
    lists = funnel.dashboard_rollup(rows, AS_OF, {"top": 20, "history": 80, "needs_review": 80}).select("list_name", "opportunity_key", "risk_score")
    totals = funnel.dashboard_totals(rows, AS_OF).select(
        F.col("total_opportunities_seen").alias("total_seen"), F.col("active_opportunities").alias("total_active"),
        F.col("history_opportunities").alias("total_history"), F.col("needs_review_opportunities").alias("total_review"))
    long = totals.unpivot([], totals.columns, "list_name", "value").select(
        "list_name", F.col("value").cast("string").alias("opportunity_key"), F.lit(None).cast("double").alias("risk_score"))
    return lists.unionByName(long)


_LINES = """cast(position AS varchar) || '. [' || category || '] ' || title[1:96] || chr(10) || '   型号: ' || coalesce(model, '型号 unknown') || ' | 数量: ' || coalesce(cast(nullif(quantity, 0) AS varchar), 'unknown')
  || ' | 总价: ' || CASE WHEN total_price <> 0 THEN '$' || format('{:,.0f}', total_price) ELSE '价格 unknown' END || ' | ' || CASE WHEN cost_per_unit <> 0 THEN '$' || format('{:,.2f}', cost_per_unit) || '/unit' ELSE '单件成本 unknown' END
  || chr(10) || '   地点: ' || coalesce(location_state, '地点 unknown') || ' | 剩余时间: unknown | 完整度: ' || component_completeness
  || chr(10) || '   状态: ' || listing_status || ' | 建议: ' || recommendation || ' | 风险: ' || coalesce(nullif(array_to_string(recommendation_reasons[1:4], ', '), ''), 'needs_manual_review')
  || chr(10) || '   分数: ' || cast(cast(opportunity_score AS int) AS varchar) || '/100 | 风险分: ' || cast(cast(risk_score AS int) AS varchar) || '/100 | 来源: ' || source_name || chr(10) || '   链接: ' || source_url"""


@query("report_lines", f"""{H._UNIQUE}, best AS (SELECT *, row_number() OVER (ORDER BY {H._RANK}) AS position FROM scored WHERE listing_status = 'active'),
body AS (SELECT string_agg({_LINES}, chr(10) ORDER BY position) AS b FROM best WHERE position <= 8)
SELECT m AS message, sha256(m) AS message_hash FROM (SELECT 'Opportunity report' || chr(10) || 'Top重点机会:' || chr(10) || coalesce(b, '本轮没有发现当前有效的具体硬件机会。') || chr(10) || chr(10)
  || '说明: 公开搜索发现结果需要人工核查；系统不会自动购买、出价、联系卖家或判断最终可采购性。' AS m FROM body)""")
def _(spark, sf):
    scan = scans.hardware_scan(H.hits_of(spark, sf), AS_OF, H.ORDER)
    return report.report_lines(scan.listings, AS_OF, H.ORDER, ["Opportunity report"])
