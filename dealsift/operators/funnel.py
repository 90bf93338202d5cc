"""Counters of a run: funnels, region counts, run and recheck summaries."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealsift.operators.lifecycle import is_current, is_history, is_in_review

_FAILED = ["failed", "timeout", "blocked"]


def _counts(**conditions: Column) -> list[Column]:
    return [F.count_if(condition).alias(name) for name, condition in conditions.items()]


def _long(wide: DataFrame, keys: list[str] = ()) -> DataFrame:
    values = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), values, "metric", "value")


def _changed(kind: str) -> Column:
    return F.array_contains("change_types", kind)


def hardware_funnel(raw: DataFrame, listings: DataFrame, runs: DataFrame, as_of, cap: int | None = None) -> DataFrame:
    """The counters of a hardware scan as (metric, value) rows.

    ``listings`` are deduplicated, scored and carry change types.  Every specific hit becomes one
    listing before deduplication.  The shown list is all current listings, or the best ``cap``
    by score, so its counters follow from counts alone and nothing is sorted.
    """
    kind = F.col("page_type")
    pages = raw.agg(F.count(F.lit(1)).alias("raw_results"), *_counts(
        specific_listings=kind == "specific_listing", listing_collections=kind == "listing_collection",
        source_pages=kind == "source_page", news_or_articles=kind == "news_or_article",
        irrelevant=kind == "irrelevant", normalized_listings=kind == "specific_listing"))
    status, current = F.col("listing_status"), is_current(as_of)

    def shown(count: Column) -> Column:
        return count if cap is None else F.least(F.lit(cap), count)

    counted = listings.agg(
        F.count(F.lit(1)).alias("deduplicated"),
        *_counts(
            new_opportunities=current & _changed("NEW"),
            changed_opportunities=current & (F.size("change_types") > 0) & ~_changed("NEW"),
            price_changes=_changed("PRICE_CHANGED"), quantity_changes=_changed("QUANTITY_CHANGED"),
            status_changes=_changed("STATUS_CHANGED"), active_opportunities=status == "active",
            ending_soon=status == "ending_soon", expired_removed=is_history(), unavailable_links=status == "unavailable",
            needs_manual_review=is_in_review(as_of)),
        shown(F.count_if(current)).alias("final_opportunities"),
        shown(F.count_if(current & (F.col("opportunity_score") >= 60))).alias("high_score_opportunities"))
    failed = runs.agg(*_counts(failed_sources=F.col("status").isin(_FAILED)))
    # three frames of one row each, so that every input is read once
    wide = pages.crossJoin(counted).crossJoin(failed)
    # duplicates are what normalisation produced beyond the deduplicated listings
    return _long(wide.withColumn("duplicates_removed", F.col("normalized_listings") - F.col("deduplicated")).drop("deduplicated"))


def site_funnel(judged: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counters over category and disposition, per search when keys are given."""
    kind, end = F.col("result_category"), F.col("disposition")
    return judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_results"), *_counts(
        specific_listings=kind == "specific_listing", listing_collections=kind == "listing_collection",
        source_pages=kind == "source_page", irrelevant_results=kind == "irrelevant",
        state_mismatch_removed=end == "state_mismatch", size_mismatch_removed=end == "size_mismatch",
        budget_mismatch_removed=end == "budget_mismatch", duplicates_removed=end == "duplicate",
        final_candidates=end == "final", discovery_candidates=end == "discovery"))


def supplier_funnel(suppliers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counters over normalised suppliers; the first supplier per key decides its category."""
    per_key = suppliers.groupBy(*keys, "supplier_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("supplier_category", F.struct("hit_no")).alias("_category"))
    kind = F.col("_category")
    return per_key.groupBy(*keys).agg(
        F.sum("_n").alias("raw_results"), F.sum("_n").alias("normalized_suppliers"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates_removed"),
        *_counts(low_value_filtered=kind == "D", final_suppliers=kind != "D", high_value_suppliers=kind.isin("A", "B")))


def region_funnel(rows: DataFrame, region: str = "region_name", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by region at each stage.  The specific count includes discovery rows, as before."""
    end = F.col("disposition")
    screened = F.col("power_screened") if "power_screened" in rows.columns else F.lit(False)
    return rows.filter(F.col(region).isNotNull()).groupBy(*keys, region).agg(
        F.count(F.lit(1)).alias("raw_result_count"), *_counts(
            specific_listing_count=end.isin("final", "discovery"), final_candidate_count=end == "final",
            power_screened_count=screened))


def region_stages(regions: DataFrame, queries: DataFrame, judged: DataFrame, screened: DataFrame, region: str = "region_name",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Every region of a search with its counts at the five stages: queries run, hits, specific ones, final ones, screened.

    The stages are counted in one aggregate. A region is ``success`` once a query ran for it, else ``pending``.
    """
    end = F.col("disposition")
    stages = {
        "executed_query_count": (queries, F.lit(1)), "raw_result_count": (judged, F.lit(1)),
        "specific_listing_count": (judged, F.when(end.isin("final", "discovery"), 1)),
        "final_candidate_count": (judged, F.when(end == "final", 1)), "power_screened_count": (screened, F.lit(1))}
    sources = {id(frame): frame for frame, _ in stages.values()}
    rows = [frame.filter(F.col(region).isNotNull()).select(*keys, region, *[
        (mark if of is frame else F.lit(None)).cast("int").alias(name) for name, (of, mark) in stages.items()])
        for frame in sources.values()]
    counted = reduce(DataFrame.unionByName, rows).groupBy(*keys, region).agg(*[F.count(name).alias(name) for name in stages])
    return region_fact_join(regions, counted, region, keys)


def region_fact_join(regions: DataFrame, facts: DataFrame, region: str = "region_name", keys: tuple[str, ...] = ()) -> DataFrame:
    """Region sub-jobs with their counts; missing counts are zero and the status follows them."""
    counts = [c for c in facts.columns if c not in (region, *keys)]
    joined = regions.join(facts, [*keys, region], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    ran = F.col("executed_query_count") if "executed_query_count" in joined.columns else F.col("raw_result_count")
    return joined.withColumn("status", F.when(ran > 0, F.lit("success")).otherwise(F.lit("pending")))


def source_run_summary(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    failed, zero = F.col("status").isin(_FAILED), F.col("result_count") == 0
    return runs.groupBy(*keys).agg(*_counts(failed=failed, zero=~failed & zero, successful=~failed & ~zero))


def recheck_summary(rechecked: DataFrame) -> DataFrame:
    status = F.col("listing_status")
    error = F.col("error").isNotNull() if "error" in rechecked.columns else F.lit(False)
    return rechecked.agg(F.count(F.lit(1)).alias("checked"), *_counts(
        auto_active=~error & (status == "active"), auto_ended=~error & (status == "ended"),
        ending_soon=~error & (status == "ending_soon"), needs_manual_review=~error & (status == "needs_manual_review"),
        conflicting=~error & (F.col("end_time_verification") == "conflicting"), errors=error))


def dashboard_totals(listings: DataFrame, as_of) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("total_opportunities_seen"), *_counts(
        active_opportunities=is_current(as_of), history_opportunities=is_history(),
        needs_review_opportunities=is_in_review(as_of)))


def ranked_lists(listings: DataFrame, as_of, sizes: dict[str, int], order: tuple[str, ...] = ("opportunity_key",)) -> DataFrame:
    """The first rows of the lists ``top`` (best score), ``history`` and ``needs_review`` (seen last), in one pass.

    A listing is copied to each list it belongs to; the rank limit also applies before the shuffle.
    """
    member = {"top": is_current(as_of), "history": is_history(), "needs_review": is_in_review(as_of)}
    names = F.array_compact(F.array(*[F.when(member[n], F.lit(n)) for n in sizes]))
    rows = listings.withColumn("list_name", F.explode(names))
    best = F.col("list_name") == "top"
    seen = -F.unix_micros(F.col("last_seen_at")).cast("double")
    place = Window.partitionBy("list_name").orderBy(
        F.when(best, -F.col("opportunity_score")).otherwise(seen), F.when(best, F.col("risk_score")).otherwise(F.lit(0.0)), *order)
    ranked = rows.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= max(sizes.values()))
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("list_name"))
    return ranked.filter(F.col("position") <= size)


def dashboard_rollup(listings: DataFrame, as_of, sizes: dict[str, int], order: tuple[str, ...] = ("opportunity_key",)) -> DataFrame:
    """The three ranked lists of the dashboard in the given sizes: best, latest ended, latest to review."""
    return ranked_lists(listings, as_of, sizes, order)


def executed_query_counts(runs: DataFrame, query: str = "query") -> DataFrame:
    """Runs, results and failures per query and source."""
    failed = F.col("status").isin(_FAILED)
    return runs.groupBy("source_name", query).agg(
        F.count(F.lit(1)).alias("run_count"), F.sum(F.when(~failed, F.col("result_count")).otherwise(F.lit(0))).alias("result_count"),
        *_counts(success_count=F.col("status") == "success", timeout_count=F.col("status") == "timeout",
                 failed_count=F.col("status") == "failed", blocked_count=F.col("status") == "blocked"))


def source_health(runs: DataFrame, order: tuple[str, ...] = ("completed_at", "run_id")) -> DataFrame:
    """Last success, last error and failures since the last success, per source."""
    failed = F.col("status").isin(_FAILED)
    when_ok = F.when(~failed, F.struct(*order))
    latest = runs.groupBy("source_name").agg(
        F.max(when_ok).alias("_ok"), F.max(F.when(failed, F.struct(*order, "status"))).alias("_bad"),
        F.max("completed_at").alias("last_checked_at"))
    # one small row per source; Spark broadcasts it only below its size limit
    since = runs.filter(failed).join(latest.select("source_name", "_ok"), "source_name")
    streak = since.filter(F.col("_ok").isNull() | (F.struct(*order) > F.col("_ok"))).groupBy("source_name").agg(
        F.count(F.lit(1)).alias("_streak"))
    return latest.join(streak, "source_name", "left").select(
        "source_name", F.col(f"_ok.{order[0]}").alias("last_success_at"), F.col("_bad.status").alias("last_error"),
        "last_checked_at", F.coalesce("_streak", F.lit(0)).alias("consecutive_failures"))
