"""Query registration and small builders for the comparison SQL."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-06-01 00:00:00"
EVENT_AS_OF = "2024-01-20 00:00:00"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its comparison SQL."""
    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def joined(array: str | Column, name: str | None = None) -> Column:
    """An array as one text, so results compare the same everywhere."""
    out = F.array_join(array, "|")
    return out.alias(name or array) if isinstance(array, str) or name else out


def stamp(column: str | Column, name: str | None = None) -> Column:
    out = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return out.alias(name or column) if isinstance(column, str) or name else out


# ---------------------------------------------------------------- SQL builders

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, tokens) -> str:
    """Any of the tokens occurs in the column."""
    return "(" + " OR ".join(f"contains({column}, {q(t)})" for t in tokens) + ")"


def rx(column: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({column}, {q(pattern)}, {group}, {q(flags)}), '')"


def hit(column: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({column}, {q(pattern)}, {q(flags)})"


def num(expression: str) -> str:
    return f"try_cast(replace({expression}, ',', '') AS double)"


def label_case(column: str, rules, default: str = "NULL") -> str:
    """CASE with the label of the first rule that has a token in the column."""
    return "CASE " + " ".join(f"WHEN {has(column, tokens)} THEN {q(label)}" for label, tokens in rules) + f" ELSE {default} END"


def label_list(column: str, rules) -> str:
    """List of the labels of all rules with a token in the column."""
    return flags((has(column, tokens), label) for label, tokens in rules)


def flags(pairs) -> str:
    """List of the labels whose condition holds."""
    cases = ", ".join(f"CASE WHEN {condition} THEN {q(label)} END" for condition, label in pairs)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def distinct_list(expression: str) -> str:
    """First occurrences of a list, in order."""
    return f"list_filter({expression}, lambda x, i: list_position({expression}, x) = i)"


def joined_sql(expression: str) -> str:
    return f"array_to_string({expression}, '|')"


def stamp_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


URL_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(column: str, group: int) -> str:
    return f"regexp_extract({column}, {q(URL_SPLIT)}, {group})"


def domain_sql(column: str) -> str:
    return f"regexp_replace(lower({url_part(column, 2)}), '^www\\.', '')"


def path_sql(column: str) -> str:
    return f"regexp_replace({url_part(column, 3)}, ';[^/]*$', '')"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(3958.7613 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"
