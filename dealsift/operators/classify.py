"""Page types, relevance filters and status rules as ordered conditions."""

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import times, url
from dealsift.functions.fence import keep_rows
from dealsift.functions.text import contains_any, matches, once, text_of


def ends_with_any(text: Column, tails) -> Column:
    return text.rlike("(?:" + "|".join(t.replace(".", r"\.") for t in tails) + ")$")


def has_lot_language(lowered: Column) -> Column:
    return matches(lowered, "(?:" + "|".join(rules.PAGE_LOT_PATTERNS) + ")")


def _page_verdict(source: Column, site: Column, where: Column, asked: Column, text: Column, lot: Column) -> Column:
    """Reason of the first rule that holds; the reasons of ``rules.PAGE_REASONS``."""
    def asks(*names) -> Column:
        return asked.rlike("(?:^|&)(?:" + "|".join(names) + ")=[^&]")

    blocked = ends_with_any(site, rules.PAGE_BLOCKED_DOMAINS) | contains_any(text, rules.PAGE_BLOCKED_TEXT)
    news = contains_any(where, rules.PAGE_NEWS_PATHS) | contains_any(text, rules.PAGE_NEWS_TEXT)
    specific = (
        (site.contains("govdeals.com") & where.rlike(r"/(?:en/)?asset/\d+"))
        | (site.contains("ebay.com") & (where.contains("/itm/") | where.rlike(r"/\d{10,}$")))
        | (site.contains("publicsurplus.com") & (asks("auc", "auction") | where.contains("view")))
        | (site.contains("hgpauction.com") & contains_any(where, rules.PAGE_HOUSE_LOT_PATHS) & lot)
        | (lot & contains_any(where, rules.PAGE_LOT_PATHS))
    )
    collection = (
        contains_any(where, rules.PAGE_COLLECTION_PATHS) | asks(*rules.PAGE_COLLECTION_PARAMS)
        | contains_any(text, rules.PAGE_COLLECTION_TEXT)
    )
    landing = contains_any(where, rules.PAGE_SOURCE_PATHS) | (contains_any(text, rules.PAGE_SOURCE_TEXT) & ~lot)
    return (
        F.when(blocked, F.lit("blocked")).when(news, F.lit("news")).when(specific, F.lit("specific"))
        .when(collection, F.lit("collection")).when(landing, F.lit("source"))
        .when(lot & source.isin(rules.MARKETPLACES), F.lit("marketplace")).otherwise(F.lit("none"))
    )


# Page type per deciding rule
_PAGE_TYPES = {
    "blocked": "irrelevant", "news": "news_or_article", "specific": "specific_listing",
    "collection": "listing_collection", "source": "source_page", "marketplace": "specific_listing",
    "none": "irrelevant",
}


def classify_hardware_pages(hits: DataFrame) -> DataFrame:
    """Add page type and reason.  Url parts and text are columns of their own, computed once per hit."""
    link, c = F.col("source_url"), F.col
    staged = hits.withColumns({
        "_site": url.domain(link), "_where": F.lower(url.path(link)), "_asked": url.query(link),
        "_text": F.lower(text_of(c("original_title"), c("original_description"))),
    }).withColumn("_lot", has_lot_language(F.col("_text")))
    judged = staged.withColumn("_verdict", _page_verdict(
        c("source_name"), c("_site"), c("_where"), c("_asked"), c("_text"), c("_lot")))

    def lookup(table: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c("_verdict"))

    return judged.withColumns({
        "page_type": lookup(_PAGE_TYPES), "classification_reason": lookup(rules.PAGE_REASONS),
    }).drop("_site", "_where", "_asked", "_text", "_lot", "_verdict")


def specific_only(hits: DataFrame) -> DataFrame:
    return keep_rows(hits, F.col("page_type") == "specific_listing")


def _haystack(*parts: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts]))


def hardware_relevance(hits: DataFrame) -> DataFrame:
    """Drop blocked hits, keep those that mention any hardware token."""
    text = F.col("_text")
    staged = hits.withColumn("_text", _haystack("original_title", "original_description", "domain"))
    return keep_rows(
        staged, ~contains_any(text, rules.HARDWARE_BLOCKED) & contains_any(text, rules.HARDWARE_WANTED)).drop("_text")


def category_relevance(hits: DataFrame) -> DataFrame:
    """Keep hits that mention a token of their own category; two categories have vetoes."""
    staged = hits.withColumn("_text", F.lower(text_of(F.col("original_title"), F.col("original_description"))))
    text, category = F.col("_text"), F.col("category")
    wanted = F.lit(False)
    for name, tokens in rules.CATEGORY_TOKENS.items():
        wanted = wanted | ((category == name) & contains_any(text, tokens))
    veto = ((category == "storage") & contains_any(text, rules.STORAGE_VETO)) | (
        (category == "cpu") & contains_any(text, rules.CPU_VETO) & ~contains_any(text, rules.CPU_VETO_UNLESS))
    return keep_rows(staged, ~veto & wanted).drop("_text")


def site_relevance(hits: DataFrame) -> DataFrame:
    staged = hits.withColumn("_text", F.lower(text_of(F.col("original_title"), F.col("original_description"))))
    text, domain = F.col("_text"), F.coalesce(F.col("domain"), F.lit(""))
    business = text.contains("businesses for sale") & ~contains_any(text, rules.REAL_ESTATE_TOKENS)
    return keep_rows(
        staged, ~contains_any(domain, rules.SITE_BLOCKED_DOMAINS) & ~business & contains_any(text, rules.SITE_WANTED)
    ).drop("_text")


def supplier_relevance(hits: DataFrame) -> DataFrame:
    text = F.col("_text")
    staged = hits.withColumn("_text", _haystack("original_title", "original_description", "domain"))
    return keep_rows(
        staged, ~contains_any(text, rules.SUPPLIER_BLOCKED) & ~contains_any(text, rules.SUPPLIER_LOW_VALUE_HITS)
        & contains_any(text, rules.SUPPLIER_WANTED)).drop("_text")


def _collection_path(where: Column) -> Column:
    return contains_any(where, rules.SITE_COLLECTION_PATHS)


def site_result(listing_url: Column, title: Column, description: Column, address: Column, city: Column,
                state: Column, acres: Column, sqft: Column, price: Column) -> Column:
    """Category of a site result from its url, text and extracted facts."""
    lowered = F.lower(listing_url)
    site, where = url.domain(lowered), url.trim_slashes(url.path(lowered))
    text = F.lower(text_of(title, description))
    real_estate = contains_any(text, rules.REAL_ESTATE_TOKENS)
    irrelevant = (
        contains_any(site, rules.SITE_IRRELEVANT_DOMAINS) | contains_any(text, rules.SITE_IRRELEVANT_TEXT)
        | (text.contains("businesses for sale") & ~real_estate)
        | (contains_any(site, rules.SITE_BUSINESS_DOMAINS) & ~real_estate)
    )
    collected_text = contains_any(text, rules.SITE_COLLECTION_TEXT)
    zero = F.lit(0.0)
    facts = (F.coalesce(acres, zero) != 0) | (F.coalesce(sqft, zero) != 0) | (F.coalesce(price, zero) != 0)
    specific = (
        (site.contains("commercial.century21.com") & where.contains("/listing/"))
        | (site.contains("crexi.com") & where.rlike(r"/properties/\d+"))
        | (contains_any(where, ["/listing/", "/property/"]) & ~_collection_path(where))
        | (address.isNotNull() & city.isNotNull() & state.isNotNull() & facts & ~collected_text)
    )
    collection = (
        _collection_path(where) | collected_text | contains_any(site, rules.SITE_COLLECTION_DOMAINS)
        | (site.contains("crexi.com") & where.contains("/properties/"))
    )
    return (
        F.when(irrelevant, F.lit("irrelevant")).when(specific, F.lit("specific_listing"))
        .when(collection, F.lit("listing_collection")).otherwise(F.lit("source_page"))
    )


def site_quality_flags(category: Column, acres: Column, address: Column, price: Column) -> Column:
    specific = category == "specific_listing"
    zero = F.lit(0.0)
    return F.array_compact(F.array(
        F.when(specific & (F.coalesce(acres, zero) == 0), F.lit("needs_verification: land_acres unknown")),
        F.when(specific & address.isNull(), F.lit("needs_verification: address unknown")),
        F.when(specific & (F.coalesce(price, zero) == 0), F.lit("needs_verification: price unknown")),
        F.when(category == "listing_collection", F.lit("not_formal_candidate: listing_collection")),
        F.when(category == "source_page", F.lit("not_formal_candidate: source_page")),
    ))


def source_type(domain: Column, title: Column, snippet: Column, group: Column) -> Column:
    text = F.lower(F.concat_ws(" ", domain, title, F.coalesce(snippet, F.lit(""))))
    public = domain.contains(".gov") | text.contains("government")
    return (
        F.when(public & text.contains("county"), F.lit("county_government"))
        .when(public & text.contains("city"), F.lit("city_government"))
        .when(public, F.lit("state_government"))
        .when(contains_any(text, ["utility", "electric", "power"]), F.lit("utility"))
        .when(text.contains("industrial park"), F.lit("industrial_park"))
        .when(contains_any(text, ["economic development", "development corporation"]), F.lit("economic_development"))
        .when(contains_any(text, ["broker", "real estate"]) | (group == "local_brokerage"), F.lit("local_brokerage"))
        .when(text.contains("auction"), F.lit("auction"))
        .otherwise(F.lit("other"))
    )


def trust_level(domain: Column, group: Column) -> Column:
    return F.when(
        domain.contains(".gov") | group.isin(rules.TRUSTED_SOURCE_GROUPS), F.lit("source_confirmed")
    ).otherwise(F.lit("unverified"))


# ------------------------------------------------------------- listing status

def listing_status(given: Column, lowered: Column) -> Column:
    return (
        F.when(given.isin(rules.LISTING_STATUSES), given)
        .when(contains_any(lowered, rules.ENDED_TEXT), F.lit("ended"))
        .when(contains_any(lowered, rules.ACTIVE_TEXT), F.lit("active"))
        .otherwise(F.lit("unknown"))
    )


def opportunity_status(status: Column) -> Column:
    return (
        F.when(status == "sold", F.lit("sold"))
        .when(status.isin("ended", "removed", "unavailable"), F.lit("ended"))
        .when(status.isin("active", "ending_soon"), F.lit("active"))
        .otherwise(F.lit("needs_verification"))
    )


def finalize_status(status: Column, end: Column, unavailable_reason: Column, captured: Column) -> Column:
    """Struct of status, verification override, check result and review flag."""
    computed = times.status_from_end(end, captured)
    elapsed = end.isNotNull() & status.isin("active", "ending_soon") & (computed == "ended")
    undecided = end.isNotNull() & (status.isNull() | (status == "unknown"))
    reasoned = end.isNull() & (status == "unknown") & (F.coalesce(unavailable_reason, F.lit("")) != "")
    return F.struct(
        F.when(elapsed, F.lit("ended")).when(undecided, computed)
        .when(reasoned, F.lit("needs_manual_review")).otherwise(status).alias("listing_status"),
        F.when(elapsed, F.lit("conflicting")).alias("end_time_verification"),
        F.when(elapsed, F.lit("active_text_but_end_time_elapsed")).alias("status_check_result"),
        F.coalesce(reasoned, F.lit(False)).alias("needs_manual_review"),
    )


def parse_status(http_status: Column, body: Column, timed_out: Column, error: Column) -> Column:
    """What came of a request: the failure met, else ``checked``."""
    blocked = contains_any(F.lower(F.coalesce(body, F.lit(""))), rules.BLOCKED_PAGE_TOKENS)
    return (
        F.when(timed_out, F.lit("timeout")).when(error.isNotNull(), F.lit("parse_error"))
        .when(http_status >= 400, F.lit("http_unavailable")).when(blocked, F.lit("blocked_or_challenged"))
        .otherwise(F.lit("checked"))
    )


def outcome_fields(parsed: Column, http_status: Column, error: Column) -> dict[str, Column]:
    """Status, reason and review flag that follow from a parse status."""
    failed, blocked = parsed.isin("timeout", "parse_error"), parsed == "blocked_or_challenged"
    refused = parsed == "http_unavailable"
    return {
        "listing_status": F.when(failed, F.lit("needs_manual_review")).when(refused & (http_status == 404), F.lit("removed"))
        .when(refused, F.lit("unavailable")).when(blocked, F.lit("needs_manual_review")),
        "unavailable_reason": F.when(parsed == "timeout", F.lit("detail_page_timeout")).when(failed, F.substring(error, 1, 240))
        .when(refused, F.concat(F.lit("HTTP "), http_status.cast("string"))).when(blocked, F.lit("captcha_or_access_challenge")),
        # a page without a status is not refused, nor known to be answered
        "needs_manual_review": failed | (blocked & http_status.isNotNull()),
    }


def http_outcome(http_status: Column, body: Column, timed_out: Column, error: Column) -> Column:
    """Struct of status, reason, review flag and parse status of a captured response."""
    return once(parse_status(http_status, body, timed_out, error), lambda parsed: F.struct(
        *[v.alias(n) for n, v in outcome_fields(parsed, http_status, error).items()], parsed.alias("detail_parse_status")))


def transition(status: Column, end: Column, verification: Column, result: Column, review: Column,
               checked: Column, first_seen: Column, previous_end: Column, now: Column) -> Column:
    """Struct of the status fields after the time rules."""
    elapsed = end.isNotNull() & (end <= now)
    ahead = end.isNotNull() & (end > now)
    soon = ahead & (end <= times.plus_hours(now, 24))
    revived = ahead & ~soon & status.isin("ended", "sold", "unknown", "needs_manual_review")
    gone = end.isNull() & (status == "unavailable")
    gone_elapsed = gone & F.coalesce(previous_end <= now, F.lit(False))
    gone_open = gone & ~gone_elapsed
    reference = F.coalesce(checked, first_seen)
    stale = end.isNull() & (status == "unknown") & F.coalesce(
        reference < F.timestamp_add("HOUR", F.lit(-48), now), F.lit(False))
    contradicted = elapsed & status.isin("active", "ending_soon")
    new_status = (
        F.when(elapsed, F.lit("ended")).when(soon, F.lit("ending_soon")).when(revived, F.lit("active"))
        .when(gone_elapsed, F.lit("ended")).when(gone_open | stale, F.lit("needs_manual_review")).otherwise(status)
    )
    return F.struct(
        new_status.alias("listing_status"),
        F.when(contradicted, F.lit("conflicting")).otherwise(verification).alias("end_time_verification"),
        F.when(contradicted, F.lit("active_text_but_end_time_elapsed"))
        .when(revived, F.coalesce(result, F.lit("future_end_time_overrode_page_template_status")))
        .when(gone_elapsed, F.lit("unavailable_but_historical_end_time_elapsed"))
        .when(gone_open, F.coalesce(result, F.lit("detail_page_blocked_or_unavailable")))
        .when(stale, F.lit("unknown_older_than_48h")).otherwise(result).alias("status_check_result"),
        (F.coalesce(review, F.lit(False)) | (new_status == "needs_manual_review")).alias("needs_manual_review"),
    )


def status_transition(listings: DataFrame, as_of, previous_end: str | None = None) -> DataFrame:
    """Apply the time rules to listing_status, verification, check result and review flag."""
    now = times.as_timestamp(as_of)
    names = ["listing_status", "end_time_verification", "status_check_result", "needs_manual_review"]
    kinds = dict(zip(names, ["string", "string", "string", "boolean"]))

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in listings.columns else F.lit(None).cast(kind)

    moved = transition(
        F.col("listing_status"), F.col("end_time_utc"), column("end_time_verification", "string"),
        column("status_check_result", "string"), column("needs_manual_review", "boolean"),
        column("last_status_check_at", "timestamp"), column("first_seen_at", "timestamp"),
        F.col(previous_end) if previous_end else F.lit(None).cast("timestamp"), now)
    result = listings.withColumn("_moved", moved).withColumns({n: F.col(f"_moved.{n}").cast(kinds[n]) for n in names})
    return result.withColumn("final_status", F.col("listing_status")).drop("_moved")
