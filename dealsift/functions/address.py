"""Addresses, regions and contact data found in text."""

from pyspark.sql import Column, functions as F

from dealsift import rules
from dealsift.functions.text import capture, matches, once

_STATE_CODES = "|".join(code for code, _, _ in rules.US_STATES)


def state_name(code: Column) -> Column:
    """Full state name of an upper-case code."""
    table = F.create_map(*[F.lit(x) for code_, name, _ in rules.US_STATES for x in (code_, name)])
    return F.try_element_at(table, code)


def street_address(text: Column) -> Column:
    """County road, else highway, else any street; the number may not be the tail of a figure."""
    return F.trim(F.coalesce(
        capture(text, rules.COUNTY_ROAD_PATTERN),
        capture(text, r"(?<![\d,])" + rules.HIGHWAY_PATTERN),
        capture(text, r"(?<![\d,])" + rules.STREET_PATTERN),
    ))


def clean_city(city: Column) -> Column:
    """Drop leading street words, but never the last word."""
    words = "|".join(rules.ROAD_WORDS)
    return F.regexp_replace(F.trim(F.regexp_replace(city, r"\s+", " ")), rf"(?i)^(?:\.*(?:{words})\.* )+", "")


def city_state_zip(text: Column) -> Column:
    """Struct of city, state name and zip from ``City ST 12345``."""
    pattern = (rf"\b({rules.CITY_WORD}(?:\s+{rules.CITY_WORD})?)\s*,?\s+({_STATE_CODES}),?\s+"
               r"(\d{5}(?:-\d{4})?)\b")
    return F.struct(
        clean_city(capture(text, pattern, 1, ignore_case=False)).alias("city"),
        state_name(capture(text, pattern, 2, ignore_case=False)).alias("state"),
        capture(text, pattern, 3, ignore_case=False).alias("zip_code"),
    )


def city_after_address(text: Column, address: Column) -> Column:
    """City of up to three words between the address and a state code."""
    tail = F.substring(text, F.position(address, text) + F.length(address), F.length(text))
    pattern = rf"^\s+({rules.CITY_WORD}(?:\s+{rules.CITY_WORD}){{0,2}}),?\s+({_STATE_CODES})\b"
    return F.when(
        address.isNotNull() & (address != ""), clean_city(capture(tail, pattern, 1, ignore_case=False))
    )


def city_before_state(text: Column) -> Column:
    """City in ``City, State name``."""
    names = "|".join(name for _, name, _ in sorted(rules.US_STATES, key=lambda s: s[0]))
    return capture(text, rf"\b({rules.CITY_WORD}(?:\s+{rules.CITY_WORD})?)\s*,\s*({names})\b", 1, ignore_case=False)


def zip_code(text: Column) -> Column:
    return capture(text, rules.ZIP_PATTERN, 0)


def address_status(address: Column, city: Column, state: Column) -> Column:
    return (
        F.when(address.isNotNull() & city.isNotNull() & state.isNotNull(), F.lit("full"))
        .when(address.isNotNull() | city.isNotNull() | state.isNotNull(), F.lit("partial"))
        .otherwise(F.lit("unknown"))
    )


def hardware_state(text: Column) -> Column:
    """State code of the first listed state whose name or code occurs as a word.

    One scan collects all state words of the text; the table order then decides.
    """
    words = [w for pair in rules.HARDWARE_STATE_NAMES for w in pair]
    # a look at the first letter spares most words the whole list
    first = "".join(sorted({w[0] for w in words}))
    spoken = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?=[{first}])(?:" + "|".join(words) + r")\b"), F.lit(0))

    def first_listed(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.coalesce(*[
            F.when(F.array_contains(found, name.upper()) | F.array_contains(found, code), F.lit(code))
            for name, code in rules.HARDWARE_STATE_NAMES]))

    return once(F.transform(spoken, F.upper), first_listed)


def broker_company(text: Column, strict: bool = True) -> Column:
    """Company behind ``Courtesy Of`` or ``Listed By``.

    ``strict=False`` also stops at the letter n, as the original pattern does.
    """
    body = r"([^|\n]+?)" if strict else r"([^|\\nN]+?)"
    return F.substring(F.trim(capture(text, rules.BROKER_PREFIX + body + rules.BROKER_SUFFIX)), 1, 120)


def phone(text: Column) -> Column:
    return capture(text, rules.PHONE_PATTERN, 0)


def email(text: Column) -> Column:
    return capture(text, rules.EMAIL_PATTERN, 0)


def service_area(text: Column) -> Column:
    return F.substring(capture(text, rules.SERVICE_AREA_PATTERN, 0), 1, 160)


def supplier_city(text: Column) -> Column:
    return capture(text, r"\b(" + "|".join(rules.SUPPLIER_CITIES) + r")\b")


def supplier_state(text: Column, searched_state: Column) -> Column:
    return F.when(matches(text, r"\b(Texas|TX)\b"), F.lit("Texas")).otherwise(searched_state)
