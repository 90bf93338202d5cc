"""The search flows: hits to ranked, deduplicated and screened results."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.operators import classify, funnel, hardware, retail, sites, snapshot, spatial, suppliers
from dealsift.operators.dedupe import first_wins, ranked_per_group, union_sources
from dealsift.operators.lifecycle import lifecycle_partition
from dealsift.session import shared_folder
from dealsift.sources.details import with_details
from dealsift.sources.pages import html_card_scan
from dealsift.sources.tables import read_snapshot, write_snapshot


@dataclass
class HardwareScan:
    """Frames of one hardware scan.  All are lazy; persist ``listings`` when using several."""

    classified: DataFrame
    normalized: DataFrame
    listings: DataFrame
    as_of: object
    order: list

    @property
    def current(self) -> DataFrame:
        return lifecycle_partition(self.listings, self.as_of)[0]

    @property
    def in_review(self) -> DataFrame:
        return lifecycle_partition(self.listings, self.as_of)[1]

    @property
    def history(self) -> DataFrame:
        return lifecycle_partition(self.listings, self.as_of)[2]

    def top(self, n: int) -> DataFrame:
        return hardware.rank_opportunities(self.current, *self.order).limit(n)

    def funnel(self, runs: DataFrame) -> DataFrame:
        return funnel.hardware_funnel(self.classified, self.listings, runs, self.as_of)


#: columns of the unique listings that comparison, scores, lifecycle views and the funnel read
SCAN_READS = [
    "title", "category", "model", "quantity", "current_total_cost", "total_price", "unit_price", "cost_per_unit", "current_price", "condition",
    "seller_type", "component_completeness", "shipping_available", "pickup_only", "needs_manual_review", "location_state", "confidence_level",
    "risk_flags", "buyer_premium", "status", "listing_status", "last_status_check_at", "first_seen_at", "last_seen_at", "last_changed_at", "opportunity_id"]


def hardware_scan(hits: DataFrame, as_of, order: list[str], known: DataFrame | None = None, responses: bool = False,
                  columns: list[str] | None = None) -> HardwareScan:
    """Classify, keep specific listings, read their detail pages, normalise, apply time rules, keep the first per key,
    compare with the stored snapshot and score.  Shuffles: one per key, one for the snapshot.

    With ``responses`` the hits carry the captured response of their page (see ``with_details``); the unique listings
    are then written once to the shared folder, so pages are parsed once however many frames of the scan are used.
    ``columns`` names what the caller reads of the listings: beside it only what the later steps read is sorted, written
    and compared, not the captured pages; without it all columns are."""
    classified = classify.classify_hardware_pages(hits)
    specific = classify.specific_only(classified)
    normalized = classify.status_transition(
        hardware.normalize_hardware(with_details(specific) if responses else specific, as_of), as_of)
    unique = first_wins(normalized, ["opportunity_key"], order)
    if columns is not None:
        read = {*columns, *order, "opportunity_key", *SCAN_READS}
        unique = unique.select(*[c for c in unique.columns if c in read])
    if responses:
        folder = shared_folder(hits.sparkSession, "scan")
        write_snapshot(unique, folder, 0)
        unique = read_snapshot(hits.sparkSession, folder)
    if known is None:
        unique = unique.withColumn("change_types", F.array(F.lit("NEW")))
    else:
        unique = snapshot.snapshot_diff(unique, known, as_of)
    return HardwareScan(classified, normalized, hardware.score_hardware(unique), as_of, order)


def power_screen(candidates: DataFrame, assets: DataFrame, reference: DataFrame | None = None, radii=None,
                 site_id: str = "site_id", asset_id: str = "asset_id", rows_per_task: int = 200_000) -> DataFrame:
    """Coordinates, distance gate, then nearest assets, counts and voltage per site.

    Sites that fail the gate keep their row with empty figures.
    """
    gated = spatial.geocode_lookup(candidates, reference, site_id) if reference is not None else spatial.geocode_gate(candidates)
    gated = gated.withColumns({
        "_lat": F.col("lat"), "_lon": F.col("lon"),
        "lat": F.when(F.col("can_calculate_distances"), F.col("lat")),
        "lon": F.when(F.col("can_calculate_distances"), F.col("lon"))})
    screened = spatial.power_summary(gated, assets, radii, site_id, asset_id, True, rows_per_task)
    return screened.withColumns({"lat": F.col("_lat"), "lon": F.col("_lon")}).drop("_lat", "_lon")


def site_candidates(hits: DataFrame, criteria: DataFrame, order: list[str], job: str = "job_id") -> DataFrame:
    """All hits normalised, classified and judged against the criteria of their search."""
    return sites.disposition(sites.classify_sites(sites.normalize_site(hits)), criteria, order, job)


def site_search(hits: DataFrame, criteria: DataFrame, assets: DataFrame, order: list[str], job: str = "job_id",
                site_id: str = "hit_no", reference: DataFrame | None = None, anchors: DataFrame | None = None,
                max_candidates: int | None = None, radii=None) -> DataFrame:
    """Ranked candidates per search, screened for power and checked against the anchor.

    All candidates are kept unless ``max_candidates`` is given; screening is one join for all of them. With a reference
    table of addresses the ranked candidates are first written to the shared folder.
    """
    judged = site_candidates(hits, criteria, order, job)
    scored = sites.score_site(judged.filter(F.col("disposition") == "final"))
    best = ranked_per_group(scored, [job], [F.desc("preliminary_score"), *[F.asc(o) for o in order]], max_candidates)
    if "lat" not in best.columns:
        best = best.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    if reference is not None:
        # addresses, points and results each read the candidates: judge them once
        folder = shared_folder(hits.sparkSession, "candidates")
        write_snapshot(best, folder, 0)
        best = read_snapshot(hits.sparkSession, folder)
    result = power_screen(best, assets, reference, radii, site_id=site_id)
    if anchors is None:
        return result
    return spatial.anchor_distance(result, anchors, job).filter(~F.col("outside_radius")).drop("outside_radius")


def supplier_search(hits: DataFrame, order: list[str], job: str | None = None, cap: int | None = None) -> DataFrame:
    """Normalise, keep the first per supplier, drop low-value ones, score and rank; all, or the best ``cap`` per search."""
    keys = [job] if job else []
    normalized = suppliers.normalize_supplier(hits)
    unique = first_wins(normalized, [*keys, "supplier_key"], order)
    kept, _ = suppliers.reject_low_value(unique)
    scored = suppliers.score_supplier(kept)
    ranking = [F.desc("supplier_score"), *[F.asc(o) for o in order]]
    if keys:
        return ranked_per_group(scored, keys, ranking, cap)
    ranked = scored.orderBy(*ranking)
    return ranked if cap is None else ranked.limit(cap)


def retail_search(results: DataFrame, mode: str = "all", radius: float | None = None, job: str = "job_id",
                  order: tuple[str, ...] = ("result_id",)) -> DataFrame:
    """Apply the search constraints, then score and sort."""
    kept = retail.mode_radius_filter(results, mode, radius)
    return retail.rank_by_score(retail.score_retail(kept, job), "recommendation_score", *order)


def retail_page_search(captured: dict[str, DataFrame], mode: str = "all", radius: float | None = None, page_id: str = "page_id",
                       job: str = "job_id", top: int | None = None) -> DataFrame:
    """From captured shop pages, one frame per shop, to ranked results per search.

    Cards are read and normalised per shop, shops follow each other in the fixed source order, then constraints, score and
    rank; equal scores keep the source order.
    """
    priority = dict(rules.RETAIL_SOURCE_PRIORITY)
    shops = sorted(captured, key=lambda shop: priority.get(retail.source_key(shop), 99))

    def cards(shop: str) -> DataFrame:
        pages = captured[shop].withColumn("_page", F.struct(F.col(page_id).alias("page"), F.col(job).alias("job")))
        read = html_card_scan(pages, shop, "_page")
        return read.withColumns({page_id: F.col("_page.page"), job: F.col("_page.job")}).drop("_page")

    found = [retail.normalize_retail(cards(shop), shop) for shop in shops]
    kept = retail.mode_radius_filter(union_sources(*found), mode, radius)
    order = [F.desc("recommendation_score"), "source_ord", "pos", page_id]
    return ranked_per_group(retail.score_retail(kept, job), [job], order, top)


def bulk_recheck(existing: DataFrame, fetched: DataFrame, as_of, order: list[str], limit: int | None = None) -> DataFrame:
    """Merge re-fetched rows into the listings that are due, and apply the time rules."""
    due = snapshot.recheck_candidates(existing, order, limit)
    return snapshot.recheck_merge(due, fetched, as_of)

