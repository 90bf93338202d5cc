"""End times, countdowns and status rules that depend on time.

``as_of`` is always a parameter, so a run sees one time.  The session time zone must be UTC.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from dealsift import rules
from dealsift.functions.text import capture, contains_any, once, squeeze


def as_timestamp(value) -> Column:
    """Accept a column or a literal such as ``2024-01-31 00:00:00``."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours, exact to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3600000000.0)


def plus_hours(at: Column, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours), at)


def iso_datetime(text: Column) -> Column:
    return F.replace(text, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp")


def zone_name(raw: Column) -> Column:
    """Known zone code at the end of a raw time, else null."""
    code = capture(F.trim(raw), r"\b([A-Z]{2,4})$", 1, ignore_case=False)
    # most texts have no time: a null raw time goes through no lambda, here and below
    return F.when(raw.isNotNull(), once(code, lambda c: F.when(c.isin(*rules.ZONE_OFFSET_HOURS), c)))


def parse_zoned(raw: Column) -> Column:
    """UTC timestamp of ``June 3, 2026 5:30 PM PDT`` or ``6/3/2026 5:30 PM PDT``."""
    zone = capture(raw, r"^.+\s+([A-Z]{2,4})$", 1, ignore_case=False)
    local = squeeze(capture(raw, r"^(.+)\s+[A-Z]{2,4}$", 1, ignore_case=False))

    def read(t: Column) -> Column:
        # names begin with a capital and the half of the day is in capitals; a format that does not fit costs an exception, so the shape picks it
        cased = F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.lower(F.substr(t, F.lit(2), F.length(t) - 3)), F.upper(F.right(t, F.lit(2))))
        month_name = F.when(F.substr(t, F.lit(4), F.lit(1)) == " ", F.lit("MMM")).otherwise(F.lit("MMMM"))
        days = {"/": "M/d/yyyy h:mm a", "MMM": "MMM d, yyyy h:mm a", "MMMM": "MMMM d, yyyy h:mm a"}
        shape = F.when(t.contains("/"), F.lit("/")).otherwise(month_name)
        return once(F.struct(cased.alias("t"), shape.alias("shape")), lambda x: F.coalesce(*[
            F.when(x["shape"] == kind, F.try_to_timestamp(x["t"], F.lit(f))) for kind, f in days.items()]))

    parsed = once(local, read)
    offsets = F.create_map(*[F.lit(x) for pair in rules.ZONE_OFFSET_HOURS.items() for x in pair])
    return F.when(raw.isNotNull(), F.timestamp_add("HOUR", -F.try_element_at(offsets, zone), parsed))


def _has_words(lowered: Column, needed: list[list[str]]) -> Column:
    """True where the text has a word of every list, without which a pattern cannot match."""
    return reduce(Column.__and__, [contains_any(lowered, words) for words in needed])


def absolute_end_raw(text: Column, lowered: Column | None = None) -> Column:
    lowered = F.lower(text) if lowered is None else lowered
    return F.trim(F.coalesce(*[
        F.when(_has_words(lowered, needed), capture(text, p)) for p, needed in zip(rules.END_TIME_PATTERNS, rules.END_TIME_WORDS)]))


def countdown_minutes(text: Column) -> Column:
    """Minutes in a countdown; null when it names no unit."""
    lowered = F.lower(text)
    found = F.array_compact(F.array(*[
        capture(lowered, p, 1, ignore_case=False).try_cast("bigint") * minutes for p, minutes in rules.COUNTDOWN_UNITS]))
    return F.when(text.isNotNull(), once(found, lambda parts: F.when(
        F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, b: a + b))))


def countdown_raw(text: Column, lowered: Column | None = None) -> Column:
    """First countdown phrase that yields a time above zero."""
    lowered = F.lower(text) if lowered is None else lowered

    def timed(pattern: str) -> Column:
        return once(F.trim(capture(text, pattern)), lambda x: F.when(countdown_minutes(x) > 0, x))

    return F.coalesce(*[F.when(_has_words(lowered, needed), timed(p)) for p, needed in zip(rules.COUNTDOWN_PATTERNS, rules.COUNTDOWN_WORDS)])


def status_from_end(end: Column, now: Column) -> Column:
    return (
        F.when(end.isNull(), F.lit("unknown"))
        .when(end <= now, F.lit("ended"))
        .when(end <= plus_hours(now, 24), F.lit("ending_soon"))
        .otherwise(F.lit("active"))
    )


def countdown_columns(counted: Column, raw: Column, end: Column, captured: Column) -> dict[str, Column]:
    """What is known of an end time that was counted from the capture; nulls where it was not."""
    return {
        "countdown_raw_text": F.when(counted, raw), "calculated_end_time": F.when(counted, end),
        "countdown_captured_at": F.when(counted, captured), "calculated_timezone": F.when(counted, F.lit("captured_at_utc")),
        "calculation_confidence": F.when(counted, F.lit("medium")), "time_remaining": F.when(counted, raw),
    }


def end_time_columns(df, text: str, captured_at: str, secondary: bool = False, found: str | None = None):
    """Add status, end time and verification columns read from a text column.

    A countdown beats status words; an absolute end time only fills a missing status.  ``found`` names a column for the
    countdown of the text, which may lose to an absolute end time.
    """
    text_col, captured = F.col(text), F.col(captured_at)
    df = df.withColumn("_lowered", F.lower(text_col))
    lowered = F.col("_lowered")
    df = df.withColumns({"_absolute": absolute_end_raw(text_col, lowered), "_countdown": countdown_raw(text_col, lowered)})
    kept = {found: F.col("_countdown")} if found else {}
    absolute, countdown = F.col("_absolute"), F.col("_countdown")
    df = df.withColumns({
        "_worded": F.when(lowered.contains("sold") & lowered.rlike(rules.SOLD_PATTERN), F.lit("sold"))
        .when(contains_any(lowered, rules.REMOVED_TEXT), F.lit("removed"))
        .when(contains_any(lowered, rules.CLOSED_TEXT), F.lit("ended")),
        "_by_count": absolute.isNull() & countdown.isNotNull(),
        "end_time_utc": F.when(absolute.isNotNull(), parse_zoned(absolute)).otherwise(
            F.timestamp_add("MINUTE", countdown_minutes(countdown), captured)),
    })
    end, by_count, worded = F.col("end_time_utc"), F.col("_by_count"), F.col("_worded")
    status = (
        F.when(by_count, status_from_end(end, captured))
        .when(worded.isNotNull(), worded)
        .when(end.isNotNull(), status_from_end(end, captured))
        .otherwise(F.lit("unknown"))
    )
    level = (
        F.when(by_count, F.lit("countdown_estimated"))
        .when(worded.isNull() & end.isNull(), F.lit("unknown"))
        .when(absolute.isNotNull(), F.lit("source_confirmed"))
    )
    if secondary:
        level = F.when(end.isNotNull(), F.lit("secondary_source_confirmed")).otherwise(level)
    return df.withColumns({
        "listing_status": status,
        "end_time_verification": level,
        "end_time_raw": absolute,
        "end_time_timezone_raw": zone_name(absolute),
        "timezone_needs_verification": absolute.isNotNull() & zone_name(absolute).isNull(),
        **countdown_columns(by_count, countdown, end, captured), **kept,
    }).drop("_absolute", "_countdown", "_worded", "_by_count", "_lowered")


def user_time(end: Column, zone: str = rules.REPORT_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(end, zone), "yyyy-MM-dd'T'HH:mm:ss")


def report_day(at: Column, zone: str = rules.REPORT_ZONE, hour: int = rules.REPORT_HOUR) -> Column:
    """Day whose report covers the time: days start at the report hour in the report zone."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(-hour), F.from_utc_timestamp(at, zone)))


def next_check_at(status: Column, end: Column, checked: Column, attempts: Column) -> Column:
    return (
        F.when(status.isin("ended", "sold", "removed"), plus_hours(checked, 168))
        .when(status == "ending_soon", plus_hours(checked, 1))
        .when((status == "active") & (end <= plus_hours(checked, 72)), plus_hours(checked, 6))
        .when(status == "unknown", plus_hours(checked, 12))
        .when((status == "needs_manual_review") & (attempts >= 3), F.lit(None).cast("timestamp"))
        .otherwise(plus_hours(checked, 24))
    )


def time_left(end: Column, now: Column, given: Column | None = None) -> Column:
    """``{h}h {m}m`` to the end, ``Ended`` when passed, ``Unknown`` without an end."""
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(now)) / F.lit(1000000.0))
    label = (
        F.when(end.isNull(), F.lit("Unknown"))
        .when(end <= now, F.lit("Ended"))
        .otherwise(F.concat(
            F.floor(seconds / 3600).cast("string"), F.lit("h "),
            F.floor((seconds % 3600) / 60).cast("string"), F.lit("m"),
        ))
    )
    return label if given is None else F.coalesce(F.nullif(given, F.lit("")), label)
