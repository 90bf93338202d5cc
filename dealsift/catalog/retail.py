"""Retail result queries."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog.records import cte, load, record
from dealsift.catalog.registry import q, query, rx
from dealsift.catalog.sources import _CARD, _SKU
from dealsift.operators import retail
from dealsift.plans import scans

_SRC = f"WITH {cte('retail_result')}"
_BOUND = f"""{_SRC}, bounded AS (SELECT *, min(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY job_id) AS lo, max(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY job_id) AS hi FROM {{src}}),
scaled AS (SELECT *, CASE WHEN price IS NULL THEN 0.3 WHEN lo IS NULL OR lo = hi THEN 1 ELSE greatest(0, 1 - (price - lo) / (hi - lo)) END AS price_score FROM bounded),
scored AS (SELECT *, round(CASE inventory_status WHEN 'In Stock' THEN 40 WHEN 'Check Site' THEN 20 ELSE 0 END + price_score * 30 + CASE WHEN distance <= 5 THEN 20 WHEN distance <= 25 THEN 14 WHEN distance <= 50 THEN 8 ELSE 2 END
  + CASE WHEN promotion THEN 10 ELSE 0 END, 2) AS recommendation_score FROM scaled)"""
_ALL = _BOUND.format(src="retail_result")
_KEEP = "((pickup_available AND distance <= 20) OR shipping_available)"
_FILTERED = _BOUND.format(src=f"(SELECT * FROM retail_result WHERE {_KEEP})")


def results(spark, sf) -> DataFrame:
    return record(spark, sf, "retail_result")


@query("mode_radius_filter", f"""{_SRC} SELECT 'local' AS mode, result_id FROM retail_result WHERE pickup_available AND distance <= 20 UNION ALL SELECT 'online', result_id FROM retail_result WHERE shipping_available
UNION ALL SELECT 'all', result_id FROM retail_result WHERE {_KEEP}""")
def _(spark, sf):
    parts = [retail.mode_radius_filter(results(spark, sf), m, 20).select(F.lit(m).alias("mode"), "result_id") for m in ("local", "online", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("price_bounds", f"{_SRC} SELECT job_id, min(price) FILTER (price > 0) AS min_price, max(price) FILTER (price > 0) AS max_price FROM retail_result GROUP BY job_id")
def _(spark, sf):
    return retail.price_bounds(results(spark, sf))


@query("minmax_scale", f"{_ALL} SELECT result_id, round(price_score, 6) AS price_score FROM scaled")
def _(spark, sf):
    return retail.minmax_scale(results(spark, sf)).select("result_id", F.round("price_score", 6).alias("price_score"))


@query("score_retail", f"{_ALL} SELECT result_id, job_id, recommendation_score FROM scored")
def _(spark, sf):
    return retail.score_retail(results(spark, sf)).select("result_id", "job_id", "recommendation_score")


@query("retail_search", f"{_FILTERED} SELECT result_id, job_id, recommendation_score FROM scored ORDER BY recommendation_score DESC, result_id")
def _(spark, sf):
    return scans.retail_search(results(spark, sf), "all", 20).select("result_id", "job_id", "recommendation_score")


_CARDS = "concat(title, ' ', title)"
_BRAND = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(title), {q(b.lower())}) THEN {q(b)} END" for b in rules.KNOWN_BRANDS) + ")"
_MODEL = "coalesce(" + ", ".join(f"trim({rx(_CARDS, p, 0)})" for p in rules.RETAIL_MODEL_PATTERNS) + ")"


@query("retail_page_search", f"""WITH cards AS (SELECT p_partkey AS job_id, 0 AS source_ord, i, p_name || ' RTX ' || cast(4000 + i AS varchar) AS title, 100.5 + i AS price, CASE WHEN i % 2 = 0 THEN 'Available' ELSE 'Check Site' END AS inventory_status, i % 3 = 0 AS promotion,
  'https://shop.example.com/p/' || cast(p_partkey AS varchar) || '-' || cast(i % 9 AS varchar) AS product_url, 'Newegg' AS source FROM part, unnest(range(1, 2 + p_size % 11)) AS u(i) WHERE i % 5 <> 0
UNION ALL SELECT p_partkey, 1, 0, p_name, p_size + 0.99, 'Available', true, 'https://www.bestbuy.com/site/' || cast(p_partkey AS varchar) || '.p', 'Best Buy' FROM part),
bounded AS (SELECT *, min(price) OVER (PARTITION BY job_id) AS lo, max(price) OVER (PARTITION BY job_id) AS hi FROM cards),
scored AS (SELECT *, round(CASE inventory_status WHEN 'Available' THEN 40 ELSE 20 END + CASE WHEN lo = hi THEN 1 ELSE 1 - (price::double - lo::double) / (hi::double - lo::double) END * 30 + 12 + CASE WHEN promotion THEN 10 ELSE 0 END, 2)::double AS recommendation_score FROM bounded)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY recommendation_score DESC, source_ord, i) AS rank, source, title AS product_name, {_BRAND} AS brand, {_MODEL} AS model, price::double AS price, inventory_status, product_url, recommendation_score FROM scored""")
def _(spark, sf):
    part = load(spark, sf, "part")
    shops = {"Best Buy": spark.sql(_SKU, part=part), "Newegg": spark.sql(_CARD, part=part)}
    captured = {shop: pages.withColumn("job_id", F.col("page_id")) for shop, pages in shops.items()}
    return scans.retail_page_search(captured).select("job_id", "rank", "source", "product_name", "brand", "model", "price", "inventory_status", "product_url", "recommendation_score")


@query("source_order", f"""{_SRC}, p AS (SELECT *, CASE source_key WHEN 'newegg' THEN 0 WHEN 'best_buy' THEN 1 WHEN 'micro_center' THEN 2 WHEN 'cdw' THEN 3 WHEN 'provantage' THEN 4 ELSE 99 END AS source_priority FROM retail_result)
SELECT result_id, source_key, source_priority, row_number() OVER (ORDER BY source_priority, result_id) AS position FROM p""")
def _(spark, sf):
    known = results(spark, sf).select("result_id", "source_key")
    return retail.source_order(known, "source_key", "result_id", position="position").select("result_id", "source_key", "source_priority", "position")
