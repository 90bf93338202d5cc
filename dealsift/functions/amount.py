"""Money, counts and units found in text."""

from functools import reduce
from re import escape

from pyspark.sql import Column, functions as F

from dealsift import rules
from dealsift.functions.text import capture, contains_any, matches, once, squeeze


def number(text: Column) -> Column:
    """Double from a figure with thousands commas, null when it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def float_or_none(value: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(value.cast("string"), r"[$,]", ""))
    return cleaned.try_cast("double")


def int_or_none(value: Column) -> Column:
    return F.trim(F.replace(value.cast("string"), F.lit(","), F.lit(""))).try_cast("bigint")


def first_of(*values: Column) -> Column:
    """First value that is neither null nor zero; the last one is taken as it is."""
    *early, last = values
    return F.coalesce(*[F.nullif(v, F.lit(0).cast("bigint")) for v in early], last)


def first_price(text: Column) -> Column:
    return number(capture(text, rules.DOLLAR_PATTERN))


def money_after(text: Column, labels: list[str]) -> Column:
    """Amount behind the first label, in list order, that has one."""
    tail = r"\s*:?\s*\$?\s*([0-9][0-9,]*(?:\.\d{2})?)"
    return F.coalesce(*[number(capture(text, escape(label) + tail)) for label in labels])


def int_after(text: Column, label: str) -> Column:
    return capture(text, escape(label) + r"\s*:?\s*(\d+)").try_cast("bigint")


def parse_price(text: Column) -> Column:
    return number(capture(text, rules.RETAIL_PRICE_PATTERN))


def quantity(text: Column) -> Column:
    return F.coalesce(*[capture(text, p).cast("bigint") for p in rules.QUANTITY_PATTERNS])


def buyer_premium(text: Column) -> Column:
    return F.concat(capture(text, rules.BUYER_PREMIUM_PATTERN), F.lit("%"))


def int_from(text: Column, pattern: str) -> Column:
    return capture(text, pattern).try_cast("bigint")


def two_if_present(text: Column, pattern: str) -> Column:
    """A pattern without a number means a pair."""
    return F.when(matches(text, pattern), F.lit(2).cast("bigint"))


def capacity_tb(text: Column) -> Column:
    tb = number(capture(text, r"\b(\d+(?:\.\d+)?)\s?TB\b"))
    gb = number(capture(text, r"\b(\d{3,5})\s?GB\b"))
    return F.coalesce(tb, F.round(gb / 1024, 3))


def land_acres(text: Column) -> Column:
    return number(capture(text, rules.ACRES_PATTERN))


def building_sqft(text: Column) -> Column:
    return number(capture(text, rules.SQFT_PATTERN))


def site_price(text: Column) -> Column:
    full = number(capture(text, rules.FULL_PRICE_PATTERN))
    return F.coalesce(full, number(capture(text, rules.MILLION_PRICE_PATTERN)) * F.lit(1000000.0))


def price_status(text: Column, price: Column) -> Column:
    return (
        F.when(F.coalesce(price, F.lit(0.0)) != 0, F.lit("asking_price"))
        .when(contains_any(F.lower(text), rules.CONTACT_PRICE_TEXT), F.lit("contact_for_price"))
        .otherwise(F.lit("unknown"))
    )


def osm_voltage_kv(value: Column) -> Column:
    """Kilovolts from the first entry of a voltage list given in volts or kilovolts."""
    first = F.trim(F.regexp_extract(value, "^([^;,]*)", 1)).try_cast("double")
    return once(first, lambda v: F.when(v > 1000, F.round(v / 1000, 3)).otherwise(v))


def manufacturer_model(text: Column, category: Column) -> Column:
    """Struct of maker and model from the first pattern that matches."""
    def pair(maker: Column, model: Column) -> Column:
        return F.struct(maker.cast("string").alias("manufacturer"), model.alias("model"))

    steps = []
    for pattern, maker in rules.MAKER_MODEL_PATTERNS:
        named = F.lit(maker) if maker else F.trim(capture(text, pattern, 1))
        steps.append((matches(text, pattern), pair(named, squeeze(capture(text, pattern, 2)))))
    memory, storage = rules.MEMORY_MODEL_PATTERN, rules.STORAGE_MODEL_PATTERN
    steps.append(((category == "memory") & matches(text, memory), pair(F.lit(None), F.upper(capture(text, memory)))))
    steps.append(((category == "storage") & matches(text, storage), pair(F.lit(None), capture(text, storage))))
    chain = reduce(lambda acc, step: acc.when(*step), steps, F)
    return chain.otherwise(pair(F.lit(None), F.lit(None).cast("string")))


def brand(text: Column) -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(b.lower()), F.lit(b)) for b in rules.KNOWN_BRANDS])


def retail_model(text: Column) -> Column:
    return F.coalesce(*[F.trim(capture(text, p, 0)) for p in rules.RETAIL_MODEL_PATTERNS])


def subcategory(category: Column, lowered: Column) -> Column:
    return (
        F.when((category == "gpu") & lowered.contains("h100"), F.lit("H100"))
        .when((category == "gpu") & lowered.contains("a100"), F.lit("A100"))
        .when((category == "gpu") & lowered.contains("rtx"), F.lit("RTX"))
        .when(category == "servers", F.lit("rack_server"))
        .when(category == "memory", F.lit("ecc_rdimm"))
        .when(category == "storage", F.lit("enterprise_storage"))
        .when(category == "cpu", F.lit("server_cpu"))
    )


def part_number(text: Column) -> Column:
    return F.upper(capture(text, rules.PART_NUMBER_PATTERN))


def generation(text: Column) -> Column:
    return capture(text, rules.GENERATION_PATTERN)


def configuration(text: Column) -> Column:
    """The distinct ones among the first eight specification terms."""
    specs = F.regexp_extract_all(text, F.lit("(?i)" + rules.SPEC_PATTERN), F.lit(0))
    return once(specs, lambda s: F.when(F.size(s) > 0, F.array_join(F.array_distinct(F.slice(s, 1, 8)), ", ")))
