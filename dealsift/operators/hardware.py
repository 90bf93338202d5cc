"""Hardware listings: tags, normalisation, costs and scores."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import address, amount, times, url
from dealsift.functions.text import (blank_to_null, contains_any, distinct_strings, first_match, first_token_label, strings,
                                     text_of)
from dealsift.operators.classify import listing_status, opportunity_status
from dealsift.schemas import DETAIL, HARDWARE_HIT_EXTRAS, with_missing


def condition(lowered: Column) -> Column:
    return first_token_label(lowered, rules.CONDITION_TOKENS, "unknown")


def working_status(lowered: Column, strict: bool = False) -> Column:
    """Claimed state.  ``strict`` reads "not working" as not working; the default does not."""
    negative = contains_any(lowered, ["not working", "broken"])
    positive = lowered.contains("working")
    first, second = (negative, positive) if strict else (positive, negative)
    labels = ("not_working", "claimed_working") if strict else ("claimed_working", "not_working")
    return F.when(first, F.lit(labels[0])).when(second, F.lit(labels[1])).otherwise(F.lit("unknown"))


def testing_status(lowered: Column) -> Column:
    return (
        F.when(lowered.contains("untested"), F.lit("untested"))
        .when(lowered.contains("tested"), F.lit("tested")).otherwise(F.lit("unknown"))
    )


def seller_type(lowered: Column, source: Column) -> Column:
    name = F.lower(source)
    return (
        F.when(contains_any(name, ["gov", "public surplus"]), F.lit("government_surplus"))
        .when(lowered.contains("auction") | name.contains("auction"), F.lit("auctioneer"))
        .when(contains_any(lowered, ["itad", "asset disposition"]), F.lit("itad_supplier"))
        .otherwise(F.lit("unknown"))
    )


def confidence_level(source: Column, domain: Column) -> Column:
    return (
        F.when(domain.isin(rules.MARKETPLACE_DOMAINS), F.lit("marketplace_listing"))
        .when(source.isin(rules.MARKETPLACES), F.lit("public_search_discovery"))
        .otherwise(F.lit("needs_verification"))
    )


def text_risk_flags(lowered: Column, source_url: Column, *more: Column) -> Column:
    """Flags of the words of a text and of a manual entry, then the further ones given; each once."""
    named = [F.when(contains_any(lowered, tokens), F.lit(label)) for label, tokens in rules.RISK_FLAG_TOKENS]
    return distinct_strings(*named, F.when(source_url.startswith("manual://"), F.lit("manual_unverified")), *more)


def component_completeness(lowered: Column, flags: Column) -> Column:
    steps = [(contains_any(lowered, tokens), label) for label, tokens in rules.COMPLETENESS_BEFORE_FLAGS]
    steps += [(F.array_contains(flags, flag), label) for flag, label in rules.COMPLETENESS_FLAGS]
    steps += [(contains_any(lowered, tokens), label) for label, tokens in rules.COMPLETENESS_AFTER_FLAGS]
    return reduce(lambda acc, s: acc.when(s[0], F.lit(s[1])), steps, F).otherwise(F.lit("unknown"))


def _detail_value(kind: str, argument, text: Column, lowered: Column) -> Column:
    if kind == "match":
        return first_match(text, argument)
    if kind == "int":
        return amount.int_from(text, argument)
    if kind == "dual_or_int":
        return F.coalesce(amount.two_if_present(text, argument[0]), amount.int_from(text, argument[1]))
    if kind == "has":
        return contains_any(lowered, argument)
    if kind == "lacks":
        return ~contains_any(lowered, argument)
    if kind == "has_unless":
        return lowered.contains(argument[0]) & ~lowered.contains(argument[1])
    if kind == "capacity_tb":
        return amount.capacity_tb(text)
    return F.when(lowered.contains("tray"), F.lit("tray")).otherwise(F.lit("individual"))


def component_details(text: Column, lowered: Column, category: Column, quantity: Column) -> Column:
    """Map of the attributes found for the category; values as text, missing ones left out."""
    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))

    common = [
        entry("parsed_from", F.lit("title_description_rules")),
        entry("quantity", F.nullif(quantity, F.lit(0).cast("bigint"))),
    ]
    chain = F
    for name, parts in rules.COMPONENT_RULES.items():
        found = [entry(key, _detail_value(kind, arg, text, lowered)) for key, kind, arg in parts]
        chain = chain.when(category == name, F.array(*common, *found))
    entries = chain.otherwise(F.array(*common))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def cost_columns(total: Column, current: Column, quantity: Column, category: Column, capacity_gb: Column) -> dict:
    """Unit costs; zero amounts count as missing."""
    zero = F.lit(0.0)
    cost = F.coalesce(F.nullif(total, zero), current)
    known = F.nullif(cost, zero)
    units = F.when(quantity > 0, quantity)
    unit = F.round(known / units, 2)
    return {
        "current_total_cost": cost,
        "unit_price": unit,
        "cost_per_unit": unit,
        "cost_per_gb": F.when((category == "memory") & (capacity_gb > 0), F.round(known / (capacity_gb * units), 4)),
        "cost_confidence": F.when(known.isNotNull() & (F.coalesce(quantity, F.lit(0)) != 0), F.lit("high"))
        .when(known.isNotNull(), F.lit("medium")).otherwise(F.lit("unknown")),
    }


def _detail(df: DataFrame, name: str) -> Column:
    """A detail field, null when the frame carries no such field."""
    if "detail" in df.columns and name in df.schema["detail"].dataType.fieldNames():
        return F.col(f"detail.{name}")
    return F.lit(None).cast(DETAIL[name])


def normalize_hardware(hits: DataFrame, as_of) -> DataFrame:
    """One listing per hit.  Detail-page fields win over text; zero counts as missing.

    Columns of the hits are kept, so ordering columns survive.
    """
    df = with_missing(hits, HARDWARE_HIT_EXTRAS)

    def d(name: str) -> Column:
        return _detail(hits, name)

    source_url, category = F.col("source_url"), F.col("category")
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    df = df.withColumns({
        "title": F.coalesce(blank_to_null(d("title")), F.col("original_title")),
        "raw_description": F.coalesce(blank_to_null(d("description")), F.col("original_description")),
    })
    df = df.withColumn("_text", text_of(F.col("title"), F.col("raw_description")))
    df = df.withColumns({
        "_lower": F.lower(F.col("_text")),
        "_product": amount.manufacturer_model(F.col("_text"), category),
        "total_price": F.coalesce(F.nullif(d("total_price"), zero), amount.first_price(F.col("_text"))),
        "quantity": F.coalesce(F.nullif(d("quantity"), none), amount.quantity(F.col("_text"))),
        "canonical_url": url.canonical(source_url),
        "last_status_check_at": F.coalesce(F.col("detail_checked_at"), times.as_timestamp(as_of)),
        "end_time_utc": F.coalesce(d("end_time_utc"), d("auction_end_time")),
        "status_check_attempts": F.coalesce(d("status_check_attempts"), none),
        "buyer_premium": F.coalesce(blank_to_null(d("buyer_premium")), amount.buyer_premium(F.col("_text"))),
    })
    text, lowered = F.col("_text"), F.col("_lower")
    review = F.coalesce(d("needs_manual_review"), F.lit(False))
    extra_flags = [F.when(review, F.lit("needs_manual_review")), F.when(F.col("buyer_premium").isNotNull(), F.lit("buyer_premium"))]
    df = df.withColumns({
        "listing_status": listing_status(d("listing_status"), lowered),
        "current_price": F.coalesce(F.nullif(d("current_price"), zero), F.col("total_price")),
        "risk_flags": text_risk_flags(lowered, source_url, *extra_flags),
        "component_details": component_details(text, lowered, category, F.col("quantity")),
    })
    status = F.col("listing_status")
    df = df.withColumns({
        "manufacturer": F.col("_product.manufacturer"),
        "model": F.col("_product.model"),
        "subcategory": amount.subcategory(category, lowered),
        "part_number": amount.part_number(text),
        "lot_number": d("lot_number"),
        "generation": amount.generation(text),
        "configuration": amount.configuration(text),
        "quantity_status": F.when(F.col("quantity").isNotNull(), F.lit("known")).otherwise(F.lit("unknown")),
        **cost_columns(F.col("total_price"), F.col("current_price"), F.col("quantity"), category,
                       F.try_element_at(F.col("component_details"), F.lit("capacity_gb")).cast("double")),
        "bid_count": d("bid_count"),
        "condition": condition(lowered),
        "working_status": working_status(lowered),
        "testing_status": testing_status(lowered),
        "location_city": d("location_city"),
        "location_state": F.coalesce(blank_to_null(d("location_state")), address.hardware_state(text)),
        "zip_code": d("zip_code"),
        "pickup_only": F.coalesce(d("pickup_only"), contains_any(lowered, ["pickup only", "local pickup"])),
        "shipping_available": F.coalesce(
            d("shipping_available"),
            F.when(lowered.contains("shipping"), ~lowered.contains("no shipping"))),
        "end_time_verification": F.when(
            d("end_time_verification").isin(rules.END_VERIFICATION_LEVELS), d("end_time_verification")
        ).otherwise(F.lit("unknown")),
        "end_time_raw": d("end_time_raw"),
        "end_time_timezone_raw": d("end_time_timezone_raw"),
        "timezone_needs_verification": F.coalesce(d("timezone_needs_verification"), F.lit(False)),
        "countdown_raw_text": d("countdown_raw_text"),
        "countdown_captured_at": d("countdown_captured_at"),
        "calculated_end_time": d("calculated_end_time"),
        "calculated_timezone": d("calculated_timezone"),
        "calculation_confidence": d("calculation_confidence"),
        "time_remaining": F.coalesce(blank_to_null(d("time_remaining")), blank_to_null(d("countdown_raw_text"))),
        "end_time_user_timezone": times.user_time(F.col("end_time_utc")),
        "next_status_check_at": times.next_check_at(
            status, F.col("end_time_utc"), F.col("last_status_check_at"), F.col("status_check_attempts")),
        "status_check_result": F.coalesce(
            blank_to_null(d("status_check_result")), blank_to_null(d("listing_status_reason"))),
        "status_check_error": d("status_check_error"),
        "final_status": status,
        "status": opportunity_status(status),
        "seller_name": F.coalesce(
            blank_to_null(d("seller_name")), blank_to_null(F.col("seller_name")), blank_to_null(url.domain(source_url))),
        "source_listing_id": F.coalesce(
            blank_to_null(d("source_listing_id")), blank_to_null(F.col("source_listing_id")), url.listing_id(source_url)),
        "seller_type": seller_type(lowered, F.col("source_name")),
        "confidence_level": confidence_level(F.col("source_name"), F.col("domain")),
        "component_completeness": component_completeness(lowered, F.col("risk_flags")),
        "unavailable_reason": d("unavailable_reason"),
        "needs_manual_review": review | status.isin("unknown", "needs_manual_review"),
        "first_seen_at": times.as_timestamp(as_of),
        "last_seen_at": times.as_timestamp(as_of),
    })
    df = df.withColumn("opportunity_key", url.key_of(
        F.col("canonical_url"), F.col("seller_name"), F.col("title"), F.col("model"), F.col("location_state")))
    return df.drop("_text", "_lower", "_product", "detail")


def _flag(condition_: Column, name: str) -> Column:
    return F.when(condition_, F.lit(name))


def _points(condition_: Column, points: float) -> Column:
    return F.when(condition_, F.lit(float(points))).otherwise(F.lit(0.0))


def _known(value: Column) -> Column:
    """Neither null nor zero."""
    return F.coalesce(value != 0, F.lit(False))


def score_hardware(listings: DataFrame) -> DataFrame:
    """Add opportunity and risk scores, reasons and the recommendation."""
    c = F.col
    status = c("listing_status")
    dead, review = status.isin(rules.DEAD_STATUSES), status == "needs_manual_review"
    clear = c("title").isNotNull() & (
        F.lower(c("title")).contains(c("category")) | (F.coalesce(c("model"), F.lit("")) != ""))
    bulk = F.coalesce(c("quantity") >= 5, F.lit(False))
    priced = _known(c("current_total_cost")) | _known(c("total_price")) | _known(c("unit_price"))
    cheap = priced & _known(c("cost_per_unit")) & (c("cost_per_unit") < 500)
    good, weak = c("condition").isin(rules.GOOD_CONDITIONS), c("condition").isin(rules.WEAK_CONDITIONS)
    sourcing = c("seller_type").isin(rules.SOURCING_SELLERS)
    incomplete = c("component_completeness").isin(rules.INCOMPLETE_VALUES)
    soon = status == "ending_soon"
    reachable = F.coalesce(c("shipping_available"), F.lit(False)) | ~F.coalesce(c("pickup_only"), F.lit(True))
    has_price = _known(c("total_price")) | _known(c("current_price"))
    unconfirmed = F.coalesce(c("needs_manual_review"), F.lit(False))

    gain = sum([
        _points(clear, 20), _points(bulk, 15), _points(priced, 15), _points(good, 15), _points(~good & weak, 4),
        _points(sourcing, 15), _points(reachable, 8), _points(F.coalesce(c("location_state"), F.lit("")) != "", 5),
        _points(c("confidence_level").isin("marketplace_listing", "official_source"), 7), _points(soon, 5),
    ], start=F.lit(0.0))
    danger = (
        F.size(c("risk_flags")) * 12.0 + _points(c("condition").isin(rules.RISKY_CONDITIONS), 25)
        + _points(incomplete, 15) + _points(~has_price, 10) + _points(unconfirmed, 10)
    )
    df = listings.withColumns({
        "opportunity_score": F.when(dead | review, F.lit(0.0)).otherwise(F.least(gain, F.lit(100.0))),
        "risk_score": F.when(status == "unavailable", F.lit(100.0)).when(dead, F.lit(75.0))
        .when(review, F.lit(85.0)).otherwise(F.least(danger, F.lit(100.0))),
    })
    text = rules.SCORE_REASONS
    return df.withColumns({
        "recommendation": F.when(dead, F.lit("expired"))
        .when(review, F.lit("information_incomplete"))
        .when(c("risk_score") >= 70, F.lit("high_risk"))
        .when(unconfirmed | ~_known(c("quantity")) | ~has_price, F.lit("information_incomplete"))
        .when(soon & (c("opportunity_score") >= 50), F.lit("urgent_review"))
        .when(c("opportunity_score") >= 45, F.lit("worth_tracking"))
        .otherwise(F.lit("ignore")),
        "score_reasons": F.when(dead, F.array(F.lit(text["dead"]))).when(review, F.array(F.lit(text["review"])))
        .otherwise(strings(
            _flag(clear, text["clear"]), _flag(bulk, text["bulk"]), _flag(priced, text["price"]),
            _flag(good, text["condition"]), _flag(sourcing, text["seller"]))),
        "recommendation_reasons": F.when(dead, F.array(F.lit("expired_or_unavailable")))
        .when(review, F.array(F.lit("needs_manual_review")))
        .otherwise(strings(
            _flag(bulk, "large_quantity"), _flag(cheap, "attractive_unit_cost"), _flag(good, "tested_inventory"),
            _flag(c("condition") == "untested", "unknown_condition"),
            _flag(c("condition").isin("parts_only", "salvage"), "salvage_or_parts_only"),
            _flag(sourcing & c("category").isin(rules.DATA_CENTER_CATEGORIES), "data_center_grade"),
            _flag(sourcing & ~c("category").isin(rules.DATA_CENTER_CATEGORIES), "auction_source"),
            _flag(c("pickup_only"), "pickup_only"), _flag(soon, "auction_ending_soon"),
            _flag(F.coalesce(c("buyer_premium"), F.lit("")) == "", "buyer_premium_unknown"),
            _flag(incomplete, "missing_manifest"))),
    })


def rank_opportunities(scored: DataFrame, *order: str) -> DataFrame:
    """Best first; the order columns break ties as the input order would."""
    return scored.orderBy(F.desc("opportunity_score"), F.asc("risk_score"), *[F.asc(o) for o in order])
