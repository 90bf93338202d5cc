"""Queries over sites, power assets and addresses."""

from pyspark.sql import DataFrame, functions as F

from dealsift.catalog.records import cte, record
from dealsift.catalog.registry import haversine_sql, query
from dealsift.functions import geo
from dealsift.operators import sites, spatial
from dealsift.plans import scans

RADII = [10.0, 20.0, 35.0, 50.0]
_DIST = f"round({haversine_sql('s.lat', 's.lon', 'a.lat', 'a.lon')}, 3)"
_PAIRS = f"""WITH {cte('site', 'asset')}, pairs AS (SELECT s.site_id, a.asset_id, a.asset_type, a.voltage_kv, {_DIST} AS distance_miles
  FROM site s JOIN asset a ON {_DIST} <= 50)"""
_RING = "CASE " + " ".join(f"WHEN distance_miles <= {r} THEN {r}" for r in RADII) + " END"


def pairs(spark, sf) -> DataFrame:
    return spatial.radius_join(record(spark, sf, "site"), record(spark, sf, "asset"), 50.0)


def lines(spark, sf) -> DataFrame:
    vertices = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon")))
    # three vertices per line by construction
    return record(spark, sf, "line_vertex").groupBy("line_id").agg(vertices.alias("vertices"))


@query("radius_join", f"{_PAIRS} SELECT site_id, asset_id, distance_miles FROM pairs")
def _(spark, sf):
    return pairs(spark, sf).select("site_id", "asset_id", "distance_miles")


_SEG = """CASE WHEN x2 = x1 AND y2 = y1 THEN sqrt(pow(px - x1, 2) + pow(py - y1, 2)) ELSE
  sqrt(pow(px - (x1 + greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1)), 2)
     + pow(py - (y1 + greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1)), 2)) END"""
_LINE_PAIRS = f"""WITH {cte('site', 'line_vertex')}, seg AS (SELECT a.line_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM line_vertex a JOIN line_vertex b ON b.line_id = a.line_id AND b.seq = a.seq + 1),
flat AS (SELECT s.site_id, g.line_id, s.lon * cos(radians(s.lat)) * 69.172 AS px, s.lat * 69.0 AS py, lon1 * cos(radians(s.lat)) * 69.172 AS x1, lat1 * 69.0 AS y1, lon2 * cos(radians(s.lat)) * 69.172 AS x2, lat2 * 69.0 AS y2 FROM site s CROSS JOIN seg g)
SELECT site_id, line_id AS asset_id, round(min({_SEG}), 3) AS distance_miles FROM flat GROUP BY site_id, line_id HAVING round(min({_SEG}), 3) <= 25"""


@query("point_to_polyline_miles", _LINE_PAIRS)
def _(spark, sf):
    shaped = lines(spark, sf).withColumn("_c", geo.polyline_center(F.col("vertices"))).select(
        F.col("line_id").alias("asset_id"), F.lit("transmission_line").alias("asset_type"), F.col("_c.lat").alias("lat"),
        F.col("_c.lon").alias("lon"), "vertices")
    return spatial.radius_join(record(spark, sf, "site"), shaped, 25.0).select("site_id", "asset_id", "distance_miles")


@query("polyline_center", f"WITH {cte('line_vertex')} SELECT line_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM line_vertex GROUP BY line_id")
def _(spark, sf):
    return lines(spark, sf).withColumn("_c", geo.polyline_center(F.col("vertices"))).select(
        "line_id", F.round("_c.lat", 6).alias("lat"), F.round("_c.lon", 6).alias("lon"))


_DLON = "10.0 / greatest(1.0, cos(radians(lat)) * 69.172)"


@query("bbox_prefilter", f"""WITH {cte('site')} SELECT site_id, round(lat - 10.0 / 69.0, 6) AS south, round(lat + 10.0 / 69.0, 6) AS north,
  round(lon - {_DLON}, 6) AS west, round(lon + {_DLON}, 6) AS east FROM site""")
def _(spark, sf):
    boxes = spatial.bbox_prefilter(record(spark, sf, "site"), 10.0)
    return boxes.select("site_id", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


@query("expanding_ring", f"""{_PAIRS}, ringed AS (SELECT *, min({_RING}) OVER (PARTITION BY site_id) AS ring_miles FROM pairs)
SELECT site_id, asset_id, distance_miles, cast(ring_miles AS double) AS ring_miles FROM ringed WHERE distance_miles <= ring_miles""")
def _(spark, sf):
    return spatial.expanding_ring(pairs(spark, sf), radii=RADII).select("site_id", "asset_id", "distance_miles", "ring_miles")


@query("nearest_asset", f"""{_PAIRS} SELECT site_id, asset_type, asset_id, distance_miles FROM (SELECT *, row_number() OVER (PARTITION BY site_id, asset_type ORDER BY distance_miles, asset_id) AS rn FROM pairs) WHERE rn = 1""")
def _(spark, sf):
    return spatial.nearest_asset(pairs(spark, sf)).select("site_id", "asset_type", "asset_id", "distance_miles")


@query("radius_counts", f"{_PAIRS} SELECT site_id, " + ", ".join(f"count(*) FILTER (distance_miles <= {r}) AS within_{r:g}_mile" for r in RADII) + " FROM pairs GROUP BY site_id")
def _(spark, sf):
    return spatial.radius_counts(pairs(spark, sf), radii=RADII)


@query("highest_voltage", f"{_PAIRS} SELECT site_id, max(nullif(voltage_kv, 0)) AS known_voltage_kv FROM pairs GROUP BY site_id")
def _(spark, sf):
    return spatial.highest_voltage(pairs(spark, sf))


@query("site_assets", f"{_PAIRS} SELECT site_id, asset_id, asset_type, voltage_kv, distance_miles FROM pairs ORDER BY site_id, distance_miles, asset_id")
def _(spark, sf):
    return spatial.site_assets(pairs(spark, sf)).select("site_id", "asset_id", "asset_type", "voltage_kv", "distance_miles")


@query("distance_sort", f"""{_PAIRS} SELECT s.site_id, p.asset_id, p.distance_miles, row_number() OVER (ORDER BY p.distance_miles NULLS LAST, s.site_id, p.asset_id NULLS LAST) AS position FROM site s LEFT JOIN pairs p USING (site_id)""")
def _(spark, sf):
    every = spatial.radius_left_join(record(spark, sf, "site"), record(spark, sf, "asset"), 50.0)
    return spatial.distance_sort(every, "distance_miles", "site_id", "asset_id", position="position", few_values=True)


_ANCHORS = "SELECT n_nationkey AS job_id, cast(30 + n_nationkey % 10 AS double) AS lat, cast(-90 - n_nationkey AS double) AS lon, cast(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 300 + 40 * n_nationkey END AS double) AS radius_miles FROM nation WHERE n_nationkey % 7 <> 6"
_MILES = f"round({haversine_sql('a.lat', 'a.lon', 's.lat', 's.lon')}, 3)"


@query("anchor_distance", f"""WITH {cte('site')}, anchor AS ({_ANCHORS}), placed AS (SELECT site_id, site_id % 25 AS job_id, CASE WHEN site_id % 6 <> 0 THEN lat END AS lat, lon FROM site)
SELECT s.site_id, {_MILES} AS distance_miles, CASE WHEN a.job_id IS NOT NULL AND s.lat IS NULL THEN 'needs_verification: distance_to_search_anchor unknown' END AS anchor_flag,
  coalesce(nullif(a.radius_miles, 0) < {_MILES}, false) AS outside_radius FROM placed s LEFT JOIN anchor a USING (job_id)""")
def _(spark, sf):
    placed = record(spark, sf, "site").withColumns({
        "job_id": F.col("site_id") % 25, "lat": F.when(F.col("site_id") % 6 != 0, F.col("lat"))})
    anchors = spark.sql(_ANCHORS.replace("FROM nation", "FROM {nation}"), nation=spark.read.parquet(f"{sf}/nation.parquet"))
    return spatial.anchor_distance(placed, anchors).select(
        "site_id", F.col("distance_to_search_anchor_miles").alias("distance_miles"), "anchor_flag", "outside_radius")


# ---------------------------------------------------------------- addresses

_PLACED = """SELECT c_custkey AS site_id, CASE c_custkey % 5 WHEN 0 THEN concat(cast(c_custkey AS varchar(20)), ' W IH-10') WHEN 1 THEN concat(cast(c_custkey AS varchar(20)), ' E US Hwy 290') WHEN 2 THEN concat(cast(c_custkey AS varchar(20)), ' Main Street') WHEN 3 THEN '' END AS address_line_1,
  CASE WHEN c_custkey % 7 > 0 THEN 'Boerne' END AS city, 'Texas' AS state, CASE WHEN c_custkey % 3 > 0 THEN '78006' END AS zip_code,
  cast(CASE WHEN c_custkey % 11 = 0 THEN 29.5 END AS double) AS lat, cast(CASE WHEN c_custkey % 11 = 0 THEN -98.5 END AS double) AS lon FROM {customer}"""
_REFERENCE = """SELECT concat(CASE c_custkey % 5 WHEN 0 THEN concat(cast(c_custkey AS varchar(20)), ' IH 10 W') WHEN 1 THEN concat(cast(c_custkey AS varchar(20)), ' US Highway 290 E') ELSE concat(cast(c_custkey AS varchar(20)), ' main street') END, ', Boerne, Texas, 78006') AS address,
  29.0 + cast(c_custkey % 100 AS double) / 100 AS ref_lat, -98.0 - cast(c_custkey % 100 AS double) / 100 AS ref_lon FROM {customer} WHERE c_custkey % 2 = 0"""
_FULL = "(coalesce(address_line_1, '') <> '' AND city IS NOT NULL AND zip_code IS NOT NULL)"
_RAW = "array_to_string(list_filter([nullif(address_line_1, ''), city, state, zip_code], lambda x: x IS NOT NULL), ', ')"


def _addresses(spark, sf) -> tuple[DataFrame, DataFrame]:
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    return spark.sql(_PLACED, customer=customer), spark.sql(_REFERENCE, customer=customer)


@query("geocode_gate", f"""WITH placed AS ({_PLACED.format(customer='customer')})
SELECT site_id, CASE WHEN lat IS NOT NULL THEN 'verified_address' WHEN {_FULL} THEN 'geocoding_failed' WHEN {_RAW} <> '' THEN 'partial_address' ELSE 'address_needs_verification' END AS geocoding_status,
  cast(CASE WHEN lat IS NOT NULL THEN 0.95 WHEN {_FULL} THEN 0.0 ELSE 0.2 END AS double) AS geocoding_confidence, lat IS NOT NULL AS can_calculate_distances FROM placed""")
def _(spark, sf):
    return spatial.geocode_gate(_addresses(spark, sf)[0]).select("site_id", "geocoding_status", "geocoding_confidence", "can_calculate_distances")


_TRY = f"""lower(CASE WHEN contains({_RAW}, 'W IH-10') THEN replace({_RAW}, 'W IH-10', 'IH 10 W') WHEN contains({_RAW}, 'E US Hwy 290') THEN replace({_RAW}, 'E US Hwy 290', 'US Highway 290 E') ELSE {_RAW} END)"""


@query("geocode_lookup", f"""WITH placed AS ({_PLACED.format(customer='customer')}), ref AS ({_REFERENCE.format(customer='customer')}), tried AS (SELECT *, {_TRY} AS variant FROM placed)
SELECT site_id, coalesce(t.lat, CASE WHEN {_FULL} THEN r.ref_lat END) AS lat, coalesce(t.lon, CASE WHEN {_FULL} THEN r.ref_lon END) AS lon,
  t.lat IS NOT NULL OR ({_FULL} AND r.ref_lat IS NOT NULL) AS can_calculate_distances FROM tried t LEFT JOIN ref r ON lower(r.address) = t.variant""")
def _(spark, sf):
    placed, reference = _addresses(spark, sf)
    return spatial.geocode_lookup(placed, reference).select("site_id", "lat", "lon", "can_calculate_distances")


_ASKED = "SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN cast(78000 + o_custkey % 60 AS varchar(20)) END AS anchor_zip, cast(CASE o_orderkey % 3 WHEN 1 THEN 29 + o_custkey % 5 WHEN 2 THEN -98 - o_custkey % 5 END AS double) AS first_coordinate, cast(CASE o_orderkey % 3 WHEN 1 THEN -98 WHEN 2 THEN 30 END AS double) AS second_coordinate FROM {orders}"
_ZIPS = "SELECT cast(78000 + n_nationkey AS varchar(20)) AS zip_code, cast(29 + n_nationkey AS double) / 1 AS lat, cast(-98 - n_nationkey AS double) AS lon, n_name AS state FROM {nation}"


@query("anchor_resolve", f"""WITH asked AS ({_ASKED.format(orders='orders')}), zips AS ({_ZIPS.format(nation='nation')})
SELECT request_id, CASE WHEN first_coordinate > 0 THEN first_coordinate WHEN first_coordinate < 0 THEN second_coordinate ELSE z.lat END AS lat,
  CASE WHEN first_coordinate > 0 THEN second_coordinate WHEN first_coordinate < 0 THEN first_coordinate ELSE z.lon END AS lon, CASE WHEN first_coordinate IS NULL THEN z.state END AS anchor_state,
  CASE WHEN first_coordinate IS NOT NULL OR z.lat IS NOT NULL THEN 'resolved' ELSE 'failed' END AS anchor_status FROM asked a LEFT JOIN zips z ON z.zip_code = a.anchor_zip""")
def _(spark, sf):
    asked = spark.sql(_ASKED, orders=spark.read.parquet(f"{sf}/orders.parquet"))
    zips = spark.sql(_ZIPS, nation=spark.read.parquet(f"{sf}/nation.parquet"))
    return spatial.anchor_resolve(asked, zips).select("request_id", "lat", "lon", "anchor_state", "anchor_status")


# ---------------------------------------------------------------- conflicts and screening

_SOURCED = """SELECT s_suppkey AS asset_id, CASE s_suppkey % 2 WHEN 0 THEN 'osm' ELSE 'gis' END AS source_name, 'transmission_line' AS asset_type,
  25.0 + cast((s_suppkey / 2)::int % 40 AS double) / 10 AS lat, -80.0 - cast((s_suppkey / 2)::int % 7 AS double) / 10 AS lon,
  cast(CASE WHEN s_suppkey % 12 < 4 THEN 138 WHEN s_suppkey % 2 = 0 THEN 46 WHEN s_suppkey % 12 < 10 THEN 115 END AS double) AS voltage_kv, cast(NULL AS varchar) AS owner FROM supplier WHERE s_suppkey % 9 <> 1"""
_SOURCED_SPARK = _SOURCED.replace("(s_suppkey / 2)::int", "cast(floor(s_suppkey / 2) AS int)").replace("AS varchar)", "AS string)").replace("FROM supplier", "FROM {supplier}")
_SOURCED_DUCK = _SOURCED.replace("(s_suppkey / 2)::int", "cast(floor(s_suppkey / 2) AS int)")


@query("source_conflict", f"""WITH sourced AS ({_SOURCED_DUCK}), judged AS (SELECT a.asset_id, count(b.asset_id) AS others, count(*) FILTER (a.voltage_kv <> b.voltage_kv) AS wrong
  FROM sourced a LEFT JOIN sourced b ON a.source_name <> b.source_name AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.05 GROUP BY a.asset_id)
SELECT asset_id, CASE WHEN others = 0 THEN 'estimated' WHEN wrong > 0 THEN 'conflicting' ELSE 'source_confirmed' END AS verification_status FROM judged""")
def _(spark, sf):
    sourced = spark.sql(_SOURCED_SPARK, supplier=spark.read.parquet(f"{sf}/supplier.parquet"))
    return spatial.source_conflict(sourced, 0.05).select("asset_id", "verification_status")


_SCREEN = f"""{_PAIRS}, placed AS (SELECT site_id, lat, lon FROM site), ringed AS (SELECT *, min({_RING}) OVER (PARTITION BY site_id) AS ring FROM pairs), kept AS (SELECT * FROM ringed WHERE distance_miles <= ring)
SELECT s.site_id, (SELECT min(distance_miles) FROM kept k WHERE k.site_id = s.site_id AND asset_type = 'substation') AS nearest_substation_miles,
  (SELECT max(nullif(voltage_kv, 0)) FROM kept k WHERE k.site_id = s.site_id) AS known_voltage_kv, (SELECT count(*) FROM kept k WHERE k.site_id = s.site_id) AS asset_count,
  (SELECT count(*) FROM kept k WHERE k.site_id = s.site_id AND distance_miles <= 20) AS within_20_mile,
  CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.site_id = s.site_id) THEN 'estimated' ELSE 'unknown' END AS confidence_level FROM site s"""


@query("power_screen", _SCREEN)
def _(spark, sf):
    empty = {c: F.lit(None).cast("string") for c in ("address_line_1", "city", "zip_code")}
    screened = scans.power_screen(record(spark, sf, "site").withColumns(empty), record(spark, sf, "asset"), radii=RADII)
    return screened.select("site_id", "nearest_substation_miles", "known_voltage_kv", "asset_count", "within_20_mile", "confidence_level")


@query("utility_candidate", """WITH placed AS (SELECT c_custkey AS site_id, CASE c_custkey % 4 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Georgia' WHEN 2 THEN 'Ohio' END AS state, CASE c_custkey % 3 WHEN 0 THEN 'Jackson' WHEN 1 THEN 'Austin' END AS city FROM customer)
SELECT site_id, CASE WHEN state = 'Georgia' AND city = 'Jackson' THEN 'Georgia Power or local EMC service territory' WHEN state = 'Texas' THEN 'Texas deregulated market / local TDU to verify' END AS likely_utility,
  CASE WHEN state = 'Georgia' AND city = 'Jackson' THEN 'investor_owned_or_cooperative' WHEN state = 'Texas' THEN 'tdsp_or_cooperative_unknown' ELSE 'unknown' END AS utility_type,
  CASE WHEN state = 'Georgia' AND city = 'Jackson' THEN 'Estimated from city/state: Jackson, Georgia. Must verify with parcel and utility territory map.'
    WHEN state = 'Texas' THEN 'Estimated from city/state: ' || coalesce(city, 'None') || ', Texas. Texas service territory must be verified by address.' ELSE 'No utility territory was confirmed from the available listing fields.' END AS utility_evidence FROM placed""")
def _(spark, sf):
    key = F.col("c_custkey")
    placed = spark.read.parquet(f"{sf}/customer.parquet").select(
        key.alias("site_id"), F.when(key % 4 == 0, "Texas").when(key % 4 == 1, "Georgia").when(key % 4 == 2, "Ohio").alias("state"),
        F.when(key % 3 == 0, "Jackson").when(key % 3 == 1, "Austin").alias("city"))
    return sites.utility_candidate(placed).select("site_id", "likely_utility", "utility_type", "utility_evidence")


