"""Captured hits: one schema for the three kinds, and manual imports."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealsift.functions import url
from dealsift.operators.classify import classify_hardware_pages
from dealsift.schemas import RAW_HIT, ddl, with_missing

_MANUAL = {
    "hardware": ("manual://hardware-listing", "Manual hardware listing"),
    "site": ("manual://text", "Manual pasted property description"),
    "supplier": ("manual://supplier-text", "Manual supplier description"),
}


def raw_listing_scan(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """Read captured hits with the fixed schema, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ddl(RAW_HIT)).format(fmt).load(path)


def as_hits(df: DataFrame, kind: str) -> DataFrame:
    """Bring a frame to the common hit columns; missing ones are null, the domain comes from the url."""
    full = with_missing(df, RAW_HIT)
    full = full.withColumn("domain", F.coalesce("domain", F.nullif(url.domain(F.col("source_url")), F.lit(""))))
    return full.select(F.lit(kind).alias("kind"), *[F.col(n).cast(t) for n, t in RAW_HIT.items()])


def manual_import(requests: DataFrame, kind: str = "hardware") -> DataFrame:
    """Hits of requests with ``urls`` (array) and ``text``: one per url, or one for the text alone."""
    fallback_url, fallback_title = _MANUAL[kind]
    urls = F.coalesce("urls", F.array().cast("array<string>"))
    text = F.col("text")
    entry = F.when(F.size(urls) > 0, F.transform(urls, lambda u: F.struct(u.alias("url"), u.alias("title")))).when(
        F.coalesce(text, F.lit("")) != "",
        F.array(F.struct(F.lit(fallback_url).alias("url"), F.lit(fallback_title).alias("title"))))
    rows = requests.withColumn("_e", F.explode(entry)).withColumns({
        "source_name": F.lit("Manual Import"), "source_url": F.col("_e.url"), "original_title": F.col("_e.title"),
        "original_description": text, "raw_data": F.create_map(F.lit("manual"), F.lit("true")),
    }).drop("_e", "urls", "text")
    if kind != "hardware":
        return rows
    # text-only imports are never classified
    typed = classify_hardware_pages(rows)
    pasted = F.col("source_url") == fallback_url
    return typed.withColumns({
        "page_type": F.when(pasted, F.lit("irrelevant")).otherwise(F.col("page_type")),
        "classification_reason": F.when(~pasted, F.col("classification_reason")),
    })
