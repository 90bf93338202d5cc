"""Retail search results: constraints, scaling, score and source order."""

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import amount
from dealsift.functions.text import contains_any
from dealsift.operators.positions import ordered


def mode_radius_filter(results: DataFrame, mode: str = "all", radius: float | None = None) -> DataFrame:
    """Local results need pickup within the radius, online results shipping; ``all`` takes either."""
    near = F.col("distance").isNotNull() if radius is None else F.coalesce(F.col("distance") <= radius, F.lit(False))
    local = F.col("pickup_available") & near
    online = F.col("shipping_available")
    return results.filter({"local": local, "online": online}.get(mode, local | online))


def price_bounds(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Lowest and highest positive price per search."""
    positive = F.when(F.col("price") > 0, F.col("price"))
    return results.groupBy(job).agg(F.min(positive).alias("min_price"), F.max(positive).alias("max_price"))


def scaled_price(price: Column, low: Column, high: Column) -> Column:
    """1 for the cheapest, 0 for the dearest; 0.3 without a price, 1 without a range."""
    return (
        F.when(price.isNull(), F.lit(0.3))
        .when(low.isNull() | (low == high), F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), 1 - (price - low) / (high - low)))
    )


def minmax_scale(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Add the price score.  Bounds are aggregated per search and joined back."""
    bounded = results.join(price_bounds(results, job), job, "left")
    return bounded.withColumn(
        "price_score", scaled_price(F.col("price"), F.col("min_price"), F.col("max_price"))
    ).drop("min_price", "max_price")


def inventory_points(status: Column, strict: bool = False) -> Column:
    """Stock share of the score.  ``strict`` does not read "unavailable" as available."""
    text = F.lower(F.coalesce(status, F.lit("")))
    stocked = contains_any(text, rules.IN_STOCK_TEXT)
    if strict:
        stocked = stocked & ~contains_any(text, ["unavailable", "not available"])
    return F.when(stocked, F.lit(1.0)).when(contains_any(text, rules.MAYBE_STOCK_TEXT), F.lit(0.5)).otherwise(F.lit(0.0))


def distance_points(distance: Column) -> Column:
    return (
        F.when(distance.isNull(), F.lit(0.6)).when(distance <= 5, F.lit(1.0)).when(distance <= 25, F.lit(0.7))
        .when(distance <= 50, F.lit(0.4)).otherwise(F.lit(0.1))
    )


def score_retail(results: DataFrame, job: str = "job_id", strict: bool = False) -> DataFrame:
    """Recommendation score: stock 40, price 30, distance 20, promotion 10."""
    scaled = minmax_scale(results, job)
    promotion = F.col("promotion")
    if results.schema["promotion"].dataType.typeName() != "boolean":
        promotion = F.coalesce(promotion, F.lit("")) != ""
    score = (
        inventory_points(F.col("inventory_status"), strict) * 40 + F.col("price_score") * 30
        + distance_points(F.col("distance")) * 20
        + F.when(F.coalesce(promotion, F.lit(False)), F.lit(10.0)).otherwise(F.lit(0.0))
    )
    return scaled.withColumn("recommendation_score", F.round(score, 2)).drop("price_score")


def rank_by_score(scored: DataFrame, score: str, *order: str, position: str | None = None) -> DataFrame:
    return ordered(scored, [F.desc(score), *[F.asc(o) for o in order]], position)


def source_order(df: DataFrame, source: str = "source_key", *order: str, position: str | None = None) -> DataFrame:
    """Rows of known sources first, in the fixed source order; unknown sources count 99."""
    table = F.create_map(*[F.lit(x) for pair in rules.RETAIL_SOURCE_PRIORITY for x in pair])
    known = df.withColumn("source_priority", F.coalesce(F.try_element_at(table, F.col(source)), F.lit(99)))
    return ordered(known, [F.col(o) for o in ("source_priority", *order)], position)


def source_key(source_name: str) -> str:
    return source_name.lower().replace(" ", "_")


def normalize_retail(cards: DataFrame, source_name: str) -> DataFrame:
    """Product cards as retail results."""
    title = F.concat_ws(" ", F.col("title"), F.col("title"))
    return cards.withColumns({
        "source": F.lit(source_name),
        "product_name": F.col("title"),
        "brand": amount.brand(title),
        "model": amount.retail_model(title),
        "distance": F.lit(None).cast("double"),
        "price": amount.parse_price(F.col("price_text")),
        "promotion": F.nullif(F.col("promotion"), F.lit("")),
        "inventory_status": F.col("inventory"),
        "pickup_available": F.lit(False) if source_name == "Best Buy" else F.col("pickup"),
        "shipping_available": F.col("shipping"),
        "product_url": F.col("url"),
    }).drop("title", "price_text", "inventory", "pickup", "shipping", "url")
