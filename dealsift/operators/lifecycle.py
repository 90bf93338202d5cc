"""Current, review and history views of listings, report eligibility and summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import times
from dealsift.functions.fence import keep_rows
from dealsift.functions.text import strings
from dealsift.operators.positions import ordered


def _age(as_of) -> Column:
    reference = F.coalesce(F.col("last_status_check_at"), F.col("first_seen_at"))
    return times.hours_between(times.as_timestamp(as_of), reference)


def is_current(as_of) -> Column:
    status = F.col("listing_status")
    return status.isin("active", "ending_soon") | ((status == "unknown") & F.coalesce(_age(as_of) <= 24, F.lit(False)))


def is_in_review(as_of) -> Column:
    status = F.col("listing_status")
    return (
        (status == "needs_manual_review") | F.coalesce(F.col("needs_manual_review"), F.lit(False))
        | ((status == "unknown") & F.coalesce(_age(as_of) > 24, F.lit(False)))
    )


def is_history() -> Column:
    return F.col("listing_status").isin(rules.DEAD_STATUSES)


def lifecycle_partition(listings: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current, in-review and history listings.  A listing can be current and in review."""
    return (
        listings.filter(is_current(as_of)), listings.filter(is_in_review(as_of)), listings.filter(is_history()))


def report_eligible(listings: DataFrame, as_of) -> DataFrame:
    status = F.col("listing_status")
    fresh = (status == "unknown") & ~F.coalesce(F.col("needs_manual_review"), F.lit(False)) & (_age(as_of) <= 48)
    return listings.filter(status.isin("active", "ending_soon") | F.coalesce(fresh, F.lit(False)))


def needs_verification_fields() -> Column:
    """Names of the fields of a listing that still have to be checked."""
    c, zero = F.col, F.lit(0.0)

    def missing(*names: str) -> Column:
        return F.coalesce(*[F.nullif(c(n), zero) for n in names]).isNull()

    no_place = F.coalesce(*[F.nullif(c(n), F.lit("")) for n in ("location_city", "location_state", "zip_code")]).isNull()
    return strings(
        F.when(F.coalesce(c("quantity"), F.lit(0)) == 0, F.lit("quantity")),
        F.when(missing("total_price", "current_price", "unit_price"), F.lit("price")),
        F.when(no_place, F.lit("location")),
        F.when(F.nullif(c("configuration"), F.lit("")).isNull(), F.lit("configuration")),
        F.when(c("end_time_utc").isNull(), F.lit("auction end time")),
        F.when(c("listing_status") == "unknown", F.lit("listing status")),
        F.when(c("component_completeness") == "unknown", F.lit("component completeness")),
    )


_VIEWS = {
    "current": lambda: F.col("listing_status").isin("active", "ending_soon")
    | ((F.col("listing_status") == "unknown") & ~F.col("needs_manual_review")),
    "active": lambda: F.col("listing_status") == "active",
    "ending_soon": lambda: F.col("listing_status") == "ending_soon",
    "needs_review": lambda: F.col("needs_manual_review")
    | F.col("listing_status").isin("unknown", "needs_manual_review"),
    "expired": lambda: F.col("listing_status").isin(rules.DEAD_STATUSES),
    "missing_components": lambda: F.col("component_completeness").isin(rules.INCOMPLETE_VALUES),
    "pickup_only": lambda: F.coalesce(F.col("pickup_only"), F.lit(False)),
}
VIEWS = list(_VIEWS)


def in_view(view: str) -> Column:
    return _VIEWS[view]() if view in _VIEWS else F.lit(True)


def opportunity_view(listings: DataFrame, view: str) -> DataFrame:
    return listings.filter(in_view(view))


def view_sort(listings: DataFrame, by: str, *order: str, position: str | None = None) -> DataFrame:
    """Order of a listing view; missing prices sort as -1, missing end times last."""
    c = F.col
    first = {
        "newest": F.desc("first_seen_at"),
        "price": F.desc(F.coalesce(c("current_total_cost"), c("total_price"), F.lit(-1.0))),
        "auction": F.asc_nulls_last("end_time_utc"),
        "risk": F.desc("risk_score"),
    }.get(by, F.desc("opportunity_score"))
    return ordered(listings, [first, *[F.asc(o) for o in order]], position)


def site_view(sites: DataFrame, state: str = "", place: str = "", property_type: str = "", min_acres=None,
              max_price=None, min_voltage=None, max_substation_miles=None) -> DataFrame:
    """Sites that match the filled filters; unknown figures pass."""
    c = F.col

    def holds(text: Column, part: str) -> Column:
        return F.lower(text).contains(part.lower()) if part else F.lit(True)

    def passes(column: str, bound, keep) -> Column:
        if bound is None or column not in sites.columns:
            return F.lit(True)
        return c(column).isNull() | keep(c(column), bound)

    def text(name: str) -> Column:
        return F.coalesce(c(name), F.lit("")) if name in sites.columns else F.lit("")

    return keep_rows(
        sites, holds(text("state"), state) & holds(F.concat_ws(" ", text("city"), text("county")), place)
        & holds(text("property_type"), property_type)
        & passes("land_acres", min_acres, lambda v, b: v >= b)
        & passes("asking_price_usd", max_price, lambda v, b: v <= b)
        & passes("known_voltage_kv", min_voltage, lambda v, b: v >= b)
        & passes("nearest_substation_miles", max_substation_miles, lambda v, b: v <= b))


def supplier_view(suppliers: DataFrame, category: str = "", place: str = "", capability: str = "") -> DataFrame:
    c = F.col
    kept = suppliers
    if category:
        kept = kept.filter(c("supplier_category") == category)
    if place:
        where = F.lower(F.concat_ws(" ", F.coalesce("city", F.lit("")), F.coalesce("state", F.lit(""))))
        kept = kept.filter(where.contains(place.lower()))
    if capability:
        about = F.lower(F.concat_ws(
            " ", F.coalesce("company_type", F.lit("")), F.array_join("equipment_types", " "),
            F.array_join("score_reasons", " "), F.array_join("quality_flags", " ")))
        kept = kept.filter(about.contains(capability.lower()))
    return kept
