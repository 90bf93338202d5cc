"""Text matching helpers."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed a single time, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, tokens: Iterable[str]) -> Column:
    """True when the text holds one of the tokens anywhere, also inside words."""
    return reduce(Column.__or__, [text.contains(token) for token in tokens])


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + pattern)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def capture(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """One group of the first match, null when there is none."""
    found = F.regexp_extract(text, ("(?i)" if ignore_case else "") + pattern, group)
    return once(found, lambda x: F.when(x != "", x))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; a single space is left as it is, which spares a replacement a word."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def first_match(text: Column, pattern: str) -> Column:
    """The first match with runs of white space collapsed."""
    return squeeze(capture(text, pattern, 0))


def text_of(title: Column, description: Column) -> Column:
    """Title and description as one searchable text."""
    return F.concat(title, F.lit(" "), F.coalesce(description, F.lit("")))


def slice_after(text: Column, label: str, length: int) -> Column:
    """Text from the first occurrence of the label (any case), empty when absent."""
    at = F.locate(label.lower(), F.lower(text))
    return once(at, lambda i: F.when(i > 0, F.substring(text, i, F.lit(length))).otherwise(F.lit("")))


def between(text: Column, start: str, end: str) -> Column:
    """Trimmed text between two exact markers, null when either is missing."""
    tail = F.substring(text, F.locate(start, text) + len(start), F.length(text))
    return F.when(
        text.contains(start) & tail.contains(end),
        F.trim(F.substring(tail, F.lit(1), F.locate(end, tail) - 1)),
    )


def first_token_label(text: Column, rules, default=None) -> Column:
    """Label of the first rule one of whose tokens occurs in the text."""
    chain = F
    for label, tokens in rules:
        chain = chain.when(contains_any(text, tokens), F.lit(label))
    return chain.otherwise(F.lit(default))


def token_labels(text: Column, rules) -> Column:
    """Labels of all rules with a token in the text, in rule order."""
    return distinct_strings(*[F.when(contains_any(text, tokens), F.lit(label)) for label, tokens in rules])


def distinct_strings(*conditional: Column) -> Column:
    """Array of the given strings without nulls and repeats; no lambda, so the conditions stay in generated code."""
    return F.array_except(F.array(*[c.cast("string") for c in conditional]), F.array(F.lit(None).cast("string")))


def strings(*conditional: Column) -> Column:
    """Array of the given strings without nulls."""
    return F.array_compact(F.array(*[c.cast("string") for c in conditional]))
