"""Suppliers: normalisation, category and score."""

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import address, url
from dealsift.functions.text import contains_any, once, strings, text_of, token_labels
from dealsift.schemas import SUPPLIER_HIT_EXTRAS, with_missing


def company_name(title: Column, source_url: Column) -> Column:
    """Title without its descriptive tail, else the host, else the url."""
    short = F.trim(F.regexp_replace(F.regexp_replace(title, "(?i)" + rules.COMPANY_TAIL_PATTERN, ""), r"\s*\|.*$", ""))
    host = F.regexp_replace(url.host(source_url), r"^www\.", "")
    named = once(short, lambda x: F.when(x != "", x))
    return F.coalesce(named, once(host, lambda x: F.when(x != "", x)), source_url)


def company_type(lowered: Column) -> Column:
    return (
        F.when(lowered.contains("data center decommission"), F.lit("data_center_decommissioning_company"))
        .when(contains_any(lowered, ["itad", "asset disposition"]), F.lit("itad_company"))
        .when(lowered.contains("server") & contains_any(lowered, ["wholesale", "refurb"]), F.lit("used_server_wholesaler"))
        .when(contains_any(lowered, ["electronics recycler", "recycling"]), F.lit("electronics_recycler"))
        .when(contains_any(lowered, ["asset remarketing", "asset recovery"]), F.lit("asset_remarketing_company"))
        .otherwise(F.lit("supplier_discovered"))
    )


def cert_status(lowered: Column, token: str, discovery_mode: Column) -> Column:
    listed = F.coalesce(discovery_mode == "directory_search_discovery", F.lit(False))
    return (
        F.when(~lowered.contains(token), F.lit("unknown"))
        .when(listed, F.lit("directory_discovered")).otherwise(F.lit("claimed_on_website"))
    )


def category() -> Column:
    """A to D from the capability columns."""
    c = F.col
    return (
        F.when(c("data_center_decommissioning") & (c("direct_asset_purchasing") | c("asset_remarketing")), F.lit("A"))
        .when(c("enterprise_itad") | c("asset_remarketing") | c("data_center_decommissioning"), F.lit("B"))
        .when(c("server_recycling") | c("computer_refurbishing") | c("wholesale") | c("bulk_sales"), F.lit("C"))
        .otherwise(F.lit("D"))
    )


def quality_flags(lowered: Column) -> Column:
    text = rules.SUPPLIER_FLAGS
    return strings(
        F.lit(text["always"]),
        F.when(contains_any(lowered, rules.SUPPLIER_LOW_VALUE_TEXT), F.lit(text["low_value"])),
        F.when(F.col("phone").isNull() & F.col("email").isNull(), F.lit(text["contact"])),
        F.when(F.col("r2_certified") != "verified", F.lit(text["cert"])))


def normalize_supplier(hits: DataFrame) -> DataFrame:
    """Supplier columns from captured hits.  Hit columns are kept."""
    df = with_missing(hits, SUPPLIER_HIT_EXTRAS).withColumn(
        "_text", text_of(F.col("original_title"), F.col("original_description")))
    df = df.withColumn("_lower", F.lower("_text"))
    text, lowered = F.col("_text"), F.col("_lower")
    df = df.withColumns({
        "company_name": company_name(F.col("original_title"), F.col("source_url")),
        "company_type": company_type(lowered),
        "website": url.root(F.col("source_url")),
        "city": address.supplier_city(text),
        "state": address.supplier_state(text, F.col("state")),
        "zip_code": address.zip_code(text),
        "phone": address.phone(text),
        "email": address.email(text),
        "service_area": address.service_area(text),
        **{name: contains_any(lowered, tokens) for name, tokens in rules.SUPPLIER_CAPABILITIES},
        "equipment_types": token_labels(lowered, rules.SUPPLIER_EQUIPMENT),
        **{name: cert_status(lowered, token, F.col("discovery_mode")) for name, token in rules.SUPPLIER_CERTS},
        "confidence_level": F.lit("needs_verification"),
    })
    df = df.withColumns({"supplier_category": category(), "quality_flags": quality_flags(lowered)})
    return df.withColumn("supplier_key", supplier_key()).drop("_text", "_lower")


def supplier_key() -> Column:
    """Host of the website, else the company name."""
    site = F.col("website")
    return F.when(F.coalesce(site, F.lit("")) != "", url.domain(site)).otherwise(F.lower("company_name"))


def reject_low_value(suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suppliers worth keeping and those of category D."""
    low = F.col("supplier_category") == "D"
    return suppliers.filter(~low), suppliers.filter(low)


def score_supplier(suppliers: DataFrame) -> DataFrame:
    c = F.col
    kind = c("supplier_category")
    sells = c("asset_remarketing") | c("direct_asset_purchasing")
    servers = c("server_recycling") | F.array_contains("equipment_types", "servers")
    bulk = c("bulk_sales") | c("wholesale")

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))

    certs = sum((
        points(c(name) == "verified", 5) + points(c(name).isin("directory_discovered", "claimed_on_website"), 3)
        for name, _ in rules.SUPPLIER_CERTS), start=F.lit(0.0))
    certs = F.least(certs, F.lit(15.0))
    score = (
        points(kind == "A", 25) + points(kind == "B", 18) + points(kind == "C", 10) + points(sells, 20)
        + points(servers, 15) + certs + points(bulk, 10) + points(c("data_center_decommissioning"), 5)
        + points(c("phone").isNotNull(), 3) + points(c("email").isNotNull(), 2)
        + points(c("state").isNotNull() | c("city").isNotNull(), 5)
    )
    return suppliers.withColumns({
        "supplier_score": F.round(F.least(score, F.lit(100.0)), 2),
        "score_reasons": strings(
            F.when(kind == "A", F.lit("Likely direct enterprise/data-center asset source"))
            .when(kind == "B", F.lit("ITAD/asset disposition capability"))
            .when(kind == "C", F.lit("Used enterprise hardware wholesale/refurbishing signal")),
            F.when(sells, F.lit("Asset remarketing or direct purchasing signal")),
            F.when(servers, F.lit("Server/data-center equipment signal")),
            F.when(certs > 0, F.lit("Certification signal requires verification")),
            F.when(bulk, F.lit("Bulk sales / wholesale signal")),
            F.when(c("data_center_decommissioning"), F.lit("Onsite decommissioning signal"))),
    })
