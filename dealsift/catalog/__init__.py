"""Registered queries over the given tables, each with SQL that gives the same rows where SQL can."""

from collections.abc import Callable

from dealsift.catalog.registry import ORACLES, QUERIES


def _register() -> None:
    from dealsift.catalog import details, functions, hardware, history, places, requests, retail, sites, sources, streams, suppliers  # noqa: F401


def all_queries() -> dict[str, Callable]:
    from dealsift.session import configure

    _register()

    def bound(function: Callable) -> Callable:
        return lambda spark, sf_dir: function(configure(spark), sf_dir)

    return {name: bound(function) for name, function in QUERIES.items()}


def all_sql() -> dict[str, str]:
    _register()
    return dict(ORACLES)


def flagship(spark, sf_dir: str):
    _register()
    return QUERIES["rank_opportunities"](spark, sf_dir)
