"""Number labels used in reports and views."""

from pyspark.sql import Column, functions as F


def money(value: Column, digits: int = 0) -> Column:
    """``$1,234``; null stays null."""
    return F.concat(F.lit("$"), F.format_number(value, digits))


def plain_number(value: Column) -> Column:
    """Shortest form of a number: whole numbers without a fraction."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def miles(value: Column) -> Column:
    return F.concat(F.format_number(value, 2), F.lit(" mi"))


def percent(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 0), F.lit("%"))


def money_or_verify(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, money(value, 0)).otherwise(F.lit("verify"))


def date_or_verify(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit("verify"))
