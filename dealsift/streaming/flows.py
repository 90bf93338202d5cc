"""Streams built from Spark's own operators: dedupe, windows, upserts and saved searches."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dealsift import rules
from dealsift.operators.dedupe import latest_per_key
from dealsift.operators.snapshot import change_types
from dealsift.session import shared_folder
from dealsift.sources.tables import history_append, read_snapshot, upsert_sink, write_snapshot


def stream_dedupe(observations: DataFrame, keys: list[str], time: str = "observed_at", lookback: str = "2 days") -> DataFrame:
    """Drop rows whose key was seen within the lookback."""
    return observations.withWatermark(time, lookback).dropDuplicatesWithinWatermark(keys)


def daily_report_window(observations: DataFrame, time: str = "observed_at", lateness: str = "2 hours",
                        keys: tuple[str, ...] = ("listing_status",), zone: str = rules.REPORT_ZONE,
                        hour: int = rules.REPORT_HOUR) -> DataFrame:
    """Counts per report day.  Days start at the report hour of the report zone; later rows than the
    lateness are dropped by the watermark."""
    local = observations.withColumn("_local", F.from_utc_timestamp(time, zone)).withWatermark("_local", lateness)
    day = F.window("_local", "1 day", startTime=f"{hour} hours")
    return local.groupBy(day.alias("_day"), *keys).agg(F.count(F.lit(1)).alias("observations")).select(
        F.to_date("_day.start").alias("report_day"), *keys, "observations")


def write_updates(root: str) -> Callable:
    """Batch handler for a stream in update mode: the changed rows of a batch in a folder named by its number, so that a
    repeated batch writes the same rows again."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return handle


def current_values(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest value per key of rows written by ``write_updates``."""
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
    return newest.select(*keys, "_newest.*")


def daily_report_counts(spark: SparkSession, observations: DataFrame, folder: str, keys: tuple[str, ...] = ("listing_status",),
                        lateness: str = "2 hours", **days) -> DataFrame:
    """Counts of all report days, unfinished ones too: a later row corrects the count of its day until it is too late.

    Takes what the source holds now; called again with the same folder, it goes on from there.
    """
    counts = daily_report_window(observations, lateness=lateness, keys=keys, **days)
    run_batches(spark, counts, write_updates(f"{folder}/updates"), folder, mode="update")
    return current_values(spark.read.parquet(f"{folder}/updates"), ["report_day", *keys], ["observations"])


def stream_upsert(snapshot_root: str, history_root: str, overwrite: list[str],
                  key: str = "opportunity_key", order: tuple[str, ...] = ("observed_at", "event_id")) -> Callable:
    """Batch handler for ``foreachBatch``: diff against the snapshot, append history, write the next version.

    Both writes go to places named by the batch number, so a repeated batch leaves the same tables.  A late row never
    replaces a newer one, so one batch and many give the same snapshot.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(key).agg(F.min(order[0]).alias("first_seen_at"))
        latest = latest_per_key(batch, key, list(order)).withColumn("last_seen_at", F.col(order[0])).join(first, key).persist()
        try:
            if not latest.isEmpty():
                store(latest, batch_id)
        finally:
            latest.unpersist()

    def store(latest: DataFrame, batch_id: int) -> None:
        current = read_snapshot(latest.sparkSession, snapshot_root, before=batch_id)
        if current is None:
            typed = latest.withColumn("change_types", F.array(F.lit("NEW")))
        else:
            before = current.select(key, F.struct("total_price_usd", "quantity", "listing_status").alias("_before"))
            typed = latest.join(before, key, "left").withColumn("change_types", change_types(
                F.col("_before"), {
                    "PRICE_CHANGED": [(F.col("total_price_usd"), F.col("_before.total_price_usd"))],
                    "QUANTITY_CHANGED": [(F.col("quantity"), F.col("_before.quantity"))],
                    "STATUS_CHANGED": [(F.col("listing_status"), F.col("_before.listing_status"))],
                })).drop("_before")
        history_append(typed.filter(F.size("change_types") > 0), history_root, order[0], batch_id)
        upsert_sink(latest, snapshot_root, [key], overwrite, batch_id, tuple(order), ("first_seen_at",))

    return handle


_NO_WORD = r"[^\p{L}\p{N}]+"


def _words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), _NO_WORD), lambda w: w != ""))


def word_counts(rows: DataFrame, searches: DataFrame, text: str = "title") -> DataFrame:
    """In how many rows each word of the searches occurs: the document frequencies of an inverted index."""
    asked = searches.select(F.explode(_words("query")).alias("word")).distinct()
    said = rows.select(F.explode(_words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(said, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def match_saved_searches(rows: DataFrame, searches: DataFrame, text: str = "title", counts: DataFrame | None = None) -> DataFrame:
    """Pairs of listing and standing search whose words all occur in the listing.

    ``searches`` has search_id, query and sources (empty for all).  Each search joins on one word only, an equi join; the
    other words are checked afterwards.  That word is the rarest by ``counts``, which are taken from the rows unless they
    are a stream; without counts it is the longest.
    """
    standing = searches.withColumn("_tokens", _words("query")).filter(F.size("_tokens") > 0)
    if counts is None and not rows.isStreaming:
        counts = word_counts(rows, searches, text)
    if counts is None:
        word = F.array_max(F.transform("_tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("w"))))["w"]
        standing = standing.withColumn("_word", word)
    else:
        named = standing.select("search_id", F.explode("_tokens").alias("word")).join(counts, "word", "left")
        rarest = named.groupBy("search_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("_word"))
        standing = standing.join(rarest, "search_id")
    if not rows.isStreaming:
        # stored, so that their size is known: a few searches are broadcast, and the words of the rows stay where they are
        folder = shared_folder(rows.sparkSession, "searches")
        write_snapshot(standing, folder, 0)
        standing = read_snapshot(rows.sparkSession, folder)
    spoken = rows.withColumn("_words", _words(text)).withColumn("_word", F.explode("_words"))
    pairs = spoken.join(standing, "_word")
    sourced = (F.size("sources") == 0) | F.array_contains("sources", F.col("source_name"))
    return pairs.filter((F.size(F.array_except("_tokens", "_words")) == 0) & sourced).drop("_words", "_word", "_tokens")


def saved_search_match(changes: DataFrame, searches: DataFrame, text: str = "title", row_id: str = "listing_no") -> DataFrame:
    """Alerts for price drops and returned stock of listings that match a standing search."""
    kinds = F.array_compact(F.array(
        F.when(F.col("price_drop"), F.lit("price_drop")), F.when(F.col("back_in_stock"), F.lit("back_in_stock"))))
    alerting = changes.withColumn("alert_type", F.explode(kinds))
    if not changes.isStreaming:
        # words are counted and matched: find the alerts once
        folder = shared_folder(changes.sparkSession, "alerts")
        write_snapshot(alerting.select(row_id, text, "source_name", "alert_type"), folder, 0)
        alerting = read_snapshot(changes.sparkSession, folder)
    return match_saved_searches(alerting, searches, text).select("search_id", row_id, "alert_type")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read the result back from a shared folder."""
    folder = shared_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(spark: SparkSession, stream: DataFrame, handler: Callable, folder: str, mode: str = "append") -> None:
    """Run a stream with a batch handler over what its source holds now."""
    query = (
        stream.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start())
    query.awaitTermination()

