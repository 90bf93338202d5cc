"""Industrial sites: normalisation, criteria, dispositions and scores."""

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import address, amount, labels, url
from dealsift.functions.fence import keep_rows
from dealsift.functions.text import contains_any, strings, text_of
from dealsift.operators.classify import site_quality_flags, site_result
from dealsift.operators.dedupe import mark_first
from dealsift.operators.positions import ordered
from dealsift.schemas import SITE_HIT_EXTRAS, with_missing


def property_type(text: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(contains_any(lowered, ["manufacturing", "factory"]), F.lit("manufacturing facility"))
        .when(lowered.contains("warehouse"), F.lit("warehouse"))
        .when(contains_any(lowered, ["industrial land", "acre"]), F.lit("industrial land"))
        .when(lowered.contains("industrial"), F.lit("industrial property"))
    )


def _filled(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) != ""


def _positive(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)) != 0


def completeness() -> Column:
    """Share of ten fields that are filled, 2 decimals."""
    c = F.col
    filled = [
        _filled(c("source_url")), _filled(c("original_title")), _filled(c("state")), _filled(c("city")),
        _filled(c("address_line_1")), _positive(c("land_acres")), _positive(c("building_sqft")),
        _positive(c("asking_price_usd")) | (c("price_status") == "contact_for_price"),
        _filled(c("property_type")), _filled(c("broker_company")),
    ]
    return F.round(sum((f.cast("int") for f in filled), start=F.lit(0)) / 10.0, 2)


def missing_fields(zoning: Column | None = None) -> Column:
    c = F.col
    zone = F.lit(None).cast("string") if zoning is None else zoning
    return strings(
        F.when(c("address_line_1").isNull(), F.lit("address")), F.when(c("land_acres").isNull(), F.lit("land_acres")),
        F.when(c("building_sqft").isNull(), F.lit("building_sqft")),
        F.when(c("asking_price_usd").isNull(), F.lit("asking_price_usd")), F.when(zone.isNull(), F.lit("zoning")))


def field_confidence() -> Column:
    """Map of field to trust level."""
    c = F.col

    def trust(known: Column) -> Column:
        return F.when(known, F.lit("source_confirmed")).otherwise(F.lit("unknown"))

    return F.create_map(
        F.lit("title"), F.lit("source_confirmed"), F.lit("source_url"), F.lit("source_confirmed"),
        F.lit("land_acres"), trust(_positive(c("land_acres"))),
        F.lit("asking_price_usd"), trust(_positive(c("asking_price_usd"))),
        F.lit("address"), trust(_filled(c("address_line_1"))), F.lit("city"), trust(_filled(c("city"))),
        F.lit("state"), trust(_filled(c("state"))), F.lit("zoning"), F.lit("unknown"))


def normalize_site(hits: DataFrame) -> DataFrame:
    """Site listing columns from captured hits.  Hit columns are kept."""
    df = with_missing(hits, SITE_HIT_EXTRAS).withColumn(
        "_text", text_of(F.col("original_title"), F.col("original_description")))
    text = F.col("_text")
    df = df.withColumns({
        "address_line_1": address.street_address(text),
        "_place": address.city_state_zip(text),
        "asking_price_usd": amount.site_price(text),
        "land_acres": amount.land_acres(text),
        "building_sqft": amount.building_sqft(text),
        "property_type": property_type(text),
        "broker_company": address.broker_company(text),
    })
    known_city = F.coalesce(address.city_after_address(text, F.col("address_line_1")), F.col("_place.city"))
    df = df.withColumns({
        "_city": known_city,
        "state": F.coalesce(F.col("_place.state"), F.col("state")),
        "zip_code": F.coalesce(F.col("_place.zip_code"), address.zip_code(text)),
        "price_status": amount.price_status(text, F.col("asking_price_usd")),
    })
    df = df.withColumns({
        "city": F.coalesce(F.col("_city"), address.city_before_state(text)),
        "address_status": address.address_status(F.col("address_line_1"), F.col("_city"), F.col("state")),
    }).drop("_text", "_place", "_city")
    return df.withColumns({
        "data_completeness_score": completeness(), "missing_fields": missing_fields(),
        "field_confidence": field_confidence(),
    })


def classify_sites(listings: DataFrame) -> DataFrame:
    c = F.col
    category = site_result(c("source_url"), c("original_title"), c("original_description"), c("address_line_1"),
                           c("city"), c("state"), c("land_acres"), c("building_sqft"), c("asking_price_usd"))
    return listings.withColumn("result_category", category).withColumn(
        "quality_flags",
        site_quality_flags(c("result_category"), c("land_acres"), c("address_line_1"), c("asking_price_usd")))


def mismatch(states: str, min_acres: str, max_price: str) -> Column:
    """First criterion a listing breaks; unknown values break none, sizes count for specific listings only."""
    c = F.col
    targets = F.transform(F.coalesce(c(states), F.array().cast("array<string>")), F.lower)
    specific = c("result_category") == "specific_listing"
    wrong_state = (F.size(targets) > 0) & _filled(c("state")) & ~F.array_contains(targets, F.lower(c("state")))
    too_small = specific & _positive(c(min_acres)) & _positive(c("land_acres")) & (c("land_acres") < c(min_acres))
    too_dear = specific & _positive(c(max_price)) & _positive(c("asking_price_usd")) & (
        c("asking_price_usd") > c(max_price))
    false = F.lit(False)
    return (
        F.when(F.coalesce(wrong_state, false), F.lit("state_mismatch"))
        .when(F.coalesce(too_small, false), F.lit("size_mismatch"))
        .when(F.coalesce(too_dear, false), F.lit("budget_mismatch"))
    )


_CRITERIA = {"states": "array<string>", "min_land_acres": "double", "max_price_usd": "double"}


def with_criteria(listings: DataFrame, criteria: DataFrame, job: str) -> DataFrame:
    known = with_missing(criteria, _CRITERIA).select(job, *[F.col(c).alias(f"_c_{c}") for c in _CRITERIA])
    return listings.join(known, job, "left")


def criteria_filter(listings: DataFrame, criteria: DataFrame, job: str = "job_id") -> DataFrame:
    """Listings that break no criterion of the search that found them."""
    joined = with_criteria(listings, criteria, job)
    reason = mismatch("_c_states", "_c_min_land_acres", "_c_max_price_usd")
    return keep_rows(joined, reason.isNull()).select(*listings.columns)


def dedupe_key() -> Column:
    """Address for specific listings that have one, else the url without query."""
    c = F.col
    placed = _filled(c("address_line_1")) & _filled(c("city")) & _filled(c("state"))
    by_address = F.lower(F.concat_ws("|", c("address_line_1"), c("city"), c("state")))
    return F.when(
        (c("result_category") == "specific_listing") & placed, by_address
    ).otherwise(url.without_query(c("source_url")))


def disposition(listings: DataFrame, criteria: DataFrame, order: list[str], job: str = "job_id") -> DataFrame:
    """Where every classified listing ends: final, discovery or the reason it was rejected."""
    joined = with_criteria(listings, criteria, job)
    reason = F.when(F.col("result_category") == "irrelevant", F.lit("irrelevant")).otherwise(
        mismatch("_c_states", "_c_min_land_acres", "_c_max_price_usd"))
    judged = joined.withColumns({
        "_reason": reason,
        "_shelf": F.when(F.col("result_category") == "specific_listing", F.lit("final")).otherwise(F.lit("discovery")),
        "dedupe_key": dedupe_key(),
    })
    # rejected rows keep apart from the first-wins choice through a key of their own
    judged = judged.withColumn("_lane", F.when(F.col("_reason").isNull(), F.col("_shelf")).otherwise(F.lit("rejected")))
    flagged = mark_first(judged, [job, "_lane", "dedupe_key"], order)
    return flagged.withColumn(
        "disposition",
        F.coalesce("_reason", F.when(F.col("is_first"), F.col("_shelf")).otherwise(F.lit("duplicate"))),
    ).select(*listings.columns, "dedupe_key", "disposition")


def score_site(listings: DataFrame) -> DataFrame:
    """Score 0-100, grade and reasons."""
    c = F.col
    zoning = c("zoning") if "zoning" in listings.columns else F.lit(None).cast("string")
    placed = _filled(c("state")) | _filled(c("city")) | _filled(c("zip_code"))

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))

    acres, price = _positive(c("land_acres")), _positive(c("asking_price_usd"))
    score = (
        points(_filled(c("property_type")), 20) + points(acres & (c("land_acres") >= 20), 15)
        + points(acres & (c("land_acres") < 20), 8) + points(_filled(zoning), 15) + points(placed, 10)
        + points(price, 10) + points(_filled(c("original_description")), 10) + points(_filled(c("source_url")), 10)
        + F.greatest(F.lit(0.0), 10.0 - F.size("missing_fields"))
    )
    scored = listings.withColumn("preliminary_score", F.round(F.least(score, F.lit(100.0)), 2))
    value = c("preliminary_score")
    return scored.withColumns({
        "preliminary_grade": F.when(value >= 80, F.lit("A")).when(value >= 65, F.lit("B"))
        .when(value >= 45, F.lit("C")).otherwise(F.lit("D")),
        "score_reasons": strings(
            F.when(_filled(c("property_type")), F.concat(F.lit("Industrial property type identified: "), c("property_type"))),
            F.when(acres, F.concat(F.lit("Land acreage found: "), labels.plain_number(c("land_acres")), F.lit(" acres"))),
            F.when(_filled(zoning), F.lit("Zoning information found")),
            F.when(placed, F.lit("Regional location information found")),
            F.when(price, F.concat(F.lit("Asking price extracted: "), labels.money(c("asking_price_usd")))),
            F.when(_filled(c("original_description")), F.lit("Source description or search snippet retained")),
            F.when(_filled(c("source_url")), F.lit("Original source URL retained"))),
    })


def listing_priority(df: DataFrame, *order: str, budget: float = 10_000_000.0, position: str | None = None) -> DataFrame:
    """Links of a listing page: over-budget ones last, then cheap before dear, then large before small."""
    text = text_of(F.col("title"), F.col("summary"))
    price = amount.number(F.regexp_extract(text, rules.FULL_PRICE_PATTERN, 1))
    acres = amount.land_acres(text)
    keyed = df.withColumns({
        "over_budget": F.coalesce((price > budget).cast("int"), F.lit(0)),
        "price_sort": F.coalesce(price, F.lit(budget)),
        "acres_sort": F.coalesce(-acres, F.lit(0.0)),
    })
    return ordered(keyed, [F.col(o) for o in ("over_budget", "price_sort", "acres_sort", *order)], position)


def utility_candidate(sites: DataFrame) -> DataFrame:
    """Likely utility of a site from a small rule table on state and city."""
    spark = sites.sparkSession
    rows = []
    for state, cities, utility, kind, tail, source in rules.UTILITY_RULES:
        for city in cities or [None]:
            rows.append((state, city, utility, kind, tail, source))
    table = F.broadcast(spark.createDataFrame(
        rows, "u_state string, u_city string, likely_utility string, u_type string, u_tail string, u_url string"))
    state, city = F.lower(F.coalesce("state", F.lit(""))), F.lower(F.coalesce("city", F.lit("")))
    joined = sites.join(table, (state == F.col("u_state")) & (F.col("u_city").isNull() | (F.col("u_city") == city)), "left")
    known = F.col("likely_utility").isNotNull()
    place = F.concat(F.coalesce("city", F.lit("None")), F.lit(", "), F.coalesce("state", F.lit("None")))
    return joined.withColumns({
        "utility_type": F.coalesce("u_type", F.lit("unknown")),
        "utility_evidence": F.when(known, F.concat(
            F.lit("Estimated from city/state: "), place, F.lit(". "), F.col("u_tail"))).otherwise(
                F.lit(rules.UTILITY_UNKNOWN_EVIDENCE)),
        "utility_source_url": F.col("u_url"),
        "utility_confidence": F.when(known, F.lit("estimated")).otherwise(F.lit("unknown")),
    }).drop("u_state", "u_city", "u_type", "u_tail", "u_url")
