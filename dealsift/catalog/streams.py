"""Streaming queries, replayed from the event table as a file source."""

from pyspark.sql import DataFrame, functions as F

from dealsift.catalog import history as V
from dealsift.catalog.hardware import ORDER
from dealsift.catalog.records import cte, record
from dealsift.catalog.registry import joined, joined_sql, query, stamp, stamp_sql
from dealsift.operators.snapshot import price_delta
from dealsift.session import STATE_STORE, shared_folder
from dealsift.sources.tables import read_snapshot
from dealsift.streaming import changes, flows


def _source(spark, sf) -> DataFrame:
    """The observation view over a stream of the event file."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    c = F.col
    return events.select(
        "event_id", F.concat(c("user_id").cast("string"), F.lit("|"), c("event_type")).alias("opportunity_key"),
        c("ts").cast("timestamp").alias("observed_at"), (F.floor(c("value") / 50).cast("bigint") * 50).alias("total_price_usd"),
        (c("event_id") % 3).cast("int").alias("quantity"),
        F.when(c("event_id") % 4 < 2, "active").when(c("event_id") % 4 == 2, "ending_soon").otherwise("ended").alias("listing_status"))


def _stateful(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


@query("stream_change_detection", f"{V._LAG} SELECT opportunity_key, event_id, total_price_usd, listing_status, {joined_sql(V._KINDS)} AS change_types FROM seen WHERE len({V._KINDS}) > 0")
def _(spark, sf):
    folder = shared_folder(spark, "change-stream")
    flows.run_batches(spark, _source(spark, sf), changes.stream_change_detection(f"{folder}/state", f"{folder}/changes"), folder)
    found = spark.read.parquet(f"{folder}/changes")
    return found.select("opportunity_key", "event_id", "total_price_usd", "listing_status", joined("change_types"))


_AGED = f"""{V._OBS}, kept AS (SELECT opportunity_key, observed_at, lead(observed_at) OVER (PARTITION BY opportunity_key ORDER BY observed_at, event_id) AS until, event_id % 3 = 0 AS unknown,
  CASE WHEN event_id % 4 < 2 THEN observed_at + INTERVAL 1 HOUR * cast(event_id % 100 AS int) END AS end_time FROM observation),
moves AS (SELECT opportunity_key, observed_at, until, end_time - INTERVAL 24 HOUR AS moved, 'ending_soon' AS listing_status FROM kept WHERE end_time IS NOT NULL UNION ALL SELECT opportunity_key, observed_at, until, end_time, 'ended' FROM kept WHERE end_time IS NOT NULL
  UNION ALL SELECT opportunity_key, observed_at, until, observed_at + INTERVAL 48 HOUR, 'needs_manual_review' FROM kept WHERE end_time IS NULL AND unknown)
SELECT opportunity_key, {stamp_sql('moved')} AS moved_at, listing_status FROM moves WHERE greatest(moved, observed_at) <= (SELECT max(observed_at) - INTERVAL 1 HOUR FROM observation) AND (until IS NULL OR greatest(moved, observed_at) < until)"""


@query("stream_status_aging", _AGED)
def _(spark, sf):
    c = F.col
    aging = _source(spark, sf).withColumns({
        "end_time_utc": F.when(c("event_id") % 4 < 2, F.timestamp_add("HOUR", (c("event_id") % 100).cast("int"), c("observed_at"))),
        "listing_status": F.when(c("event_id") % 3 == 0, F.lit("unknown")).otherwise(F.lit("active"))})
    folder = shared_folder(spark, "aging-stream")
    flows.run_batches(spark, aging, changes.stream_status_aging(f"{folder}/state", f"{folder}/moves"), folder)
    return spark.read.parquet(f"{folder}/moves").select("opportunity_key", stamp("moved_at"), "listing_status")


@query("stream_dedupe", "SELECT count(*) AS keys FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, sf):
    _stateful(spark)
    unique = flows.stream_dedupe(_source(spark, sf), ["opportunity_key"], lookback="400 days")
    return flows.run_to_table(spark, unique.select("opportunity_key", "event_id"), "dedupe").agg(F.count(F.lit(1)).alias("keys"))


@query("stream_upsert", V._OBS + """ SELECT opportunity_key, event_id, total_price_usd, quantity FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_key ORDER BY observed_at DESC, event_id DESC) AS rn FROM observation) WHERE rn = 1""")
def _(spark, sf):
    folder = shared_folder(spark, "upsert-stream")
    handler = flows.stream_upsert(f"{folder}/snapshot", f"{folder}/history", ["total_price_usd", "quantity", "listing_status", "observed_at", "last_seen_at", "event_id"])
    flows.run_batches(spark, _source(spark, sf), handler, folder)
    return read_snapshot(spark, f"{folder}/snapshot").select("opportunity_key", "event_id", "total_price_usd", "quantity")


_ZONE = "(observed_at - INTERVAL 8 HOUR - INTERVAL 8 HOUR)"


@query("daily_report_window", f"""{V._OBS}, d AS (SELECT strftime({_ZONE}, '%Y-%m-%d') AS report_day, listing_status FROM observation), last AS (SELECT max(observed_at) - INTERVAL 8 HOUR AS hi FROM observation)
SELECT report_day, listing_status, count(*) AS observations FROM d, last WHERE strptime(report_day, '%Y-%m-%d') + INTERVAL 32 HOUR <= date_trunc('second', hi - INTERVAL 2 HOUR) GROUP BY report_day, listing_status""")
def _(spark, sf):
    _stateful(spark)
    days = flows.run_to_table(spark, flows.daily_report_window(_source(spark, sf)), "report-days")
    return days.select(F.col("report_day").cast("string").alias("report_day"), "listing_status", "observations")


@query("daily_report_counts", f"""{V._OBS} SELECT strftime({_ZONE}, '%Y-%m-%d') AS report_day, listing_status, count(*) AS observations FROM observation GROUP BY ALL""")
def _(spark, sf):
    _stateful(spark)
    days = flows.daily_report_counts(spark, _source(spark, sf), shared_folder(spark, "report-counts"))
    return days.select(F.col("report_day").cast("string").alias("report_day"), "listing_status", "observations")


_SEARCHES = "SELECT n_nationkey AS search_id, concat('Dell PowerEdge R', cast(600 + n_nationkey AS varchar(20)), CASE n_nationkey % 2 WHEN 0 THEN ' tested' ELSE ' refurbished' END) AS query, n_nationkey % 3 AS mode FROM {nation}"


@query("saved_search_match", f"""WITH {cte('listing_src')}, searches AS ({_SEARCHES.format(nation='nation')}), priced AS (SELECT *, lag(amount) OVER (PARTITION BY source_url ORDER BY observed_at, listing_no, part_no, supp_no, amount) AS before FROM listing_src),
alerts AS (SELECT *, 'price_drop' AS alert_type FROM priced WHERE amount < before UNION ALL SELECT *, 'back_in_stock' FROM priced WHERE listing_no % 10 = 0)
SELECT search_id, listing_no, alert_type FROM alerts JOIN searches ON list_has_all(string_split_regex(lower(original_title), '[^\\p{{L}}\\p{{N}}]+'), string_split_regex(lower(query), '[^\\p{{L}}\\p{{N}}]+')) AND (mode <> 1 OR source_name = 'eBay')""")
def _(spark, sf):
    listed = record(spark, sf, "listing_src")
    moved = price_delta(listed, "amount", "source_url", "observed_at", tuple(ORDER[1:]), bucket="month").withColumns({
        "title": F.col("original_title"), "back_in_stock": F.col("listing_no") % 10 == 0})
    searches = spark.sql(_SEARCHES, nation=spark.read.parquet(f"{sf}/nation.parquet")).withColumn(
        "sources", F.when(F.col("mode") == 1, F.array(F.lit("eBay"))).otherwise(F.array().cast("array<string>")))
    return flows.saved_search_match(moved, searches)


