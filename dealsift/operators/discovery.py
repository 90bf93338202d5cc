"""Newly discovered source domains."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.operators.classify import source_type, trust_level
from dealsift.operators.dedupe import first_wins

_COLUMNS = ["source_name", "domain", "source_type", "trust_level", "discovery_method"]


def seeded_sources(spark) -> DataFrame:
    rows = [(n, d, t, "source_confirmed", "seeded_national_source") for n, d, t in rules.SEEDED_SOURCES]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in _COLUMNS))


def new_domains(hits: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Seeded sources plus the first hit of every domain that is neither known nor seeded."""
    seeded = seeded_sources(hits.sparkSession)
    taken = known.select("domain").unionByName(seeded.select("domain"))
    fresh = hits.filter(F.coalesce("domain", F.lit("")) != "").join(taken, "domain", "left_anti")
    first = first_wins(fresh, ["domain"], order)
    typed = first.select(
        F.substring("title", 1, 120).alias("source_name"), "domain",
        source_type(F.col("domain"), F.col("title"), F.col("snippet"), F.col("source_group")).alias("source_type"),
        trust_level(F.col("domain"), F.col("source_group")).alias("trust_level"),
        F.concat(F.lit("web_search:"), "query").alias("discovery_method"))
    return seeded.unionByName(typed)
