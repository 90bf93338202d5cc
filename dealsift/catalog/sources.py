"""Queries over captured pages, files and imports."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog.records import cte, load, record
from dealsift.catalog.registry import domain_sql, has, num, q, query, rx, stamp, stamp_sql, url_part
from dealsift.functions import times
from dealsift.operators import classify
from dealsift.sources import geofiles, hits, pages


@query("raw_listing_scan", f"""WITH {cte('listing_src', 'site_src', 'supplier_src')} SELECT kind, source_name, domain, count(*) AS hits FROM (SELECT 'hardware' AS kind, source_name, {domain_sql('source_url')} AS domain FROM listing_src
UNION ALL SELECT 'site', source_name, {domain_sql('source_url')} FROM site_src UNION ALL SELECT 'supplier', source_name, {domain_sql('source_url')} FROM supplier_src) GROUP BY ALL""")
def _(spark, sf):
    parts = [hits.as_hits(record(spark, sf, name), kind) for name, kind in (("listing_src", "hardware"), ("site_src", "site"), ("supplier_src", "supplier"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind", "source_name", "domain").agg(F.count(F.lit(1)).alias("hits"))


_ENT = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _decode(x: str) -> str:
    for name, char in _ENT:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def strip_sql(x: str) -> str:
    return "trim(regexp_replace(" + _decode(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


def visible_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "template"):
        x = f"regexp_replace({x}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gsi')"
    return x


@query("html_text", f"SELECT page_id, {strip_sql(visible_sql('html'))} AS text, {strip_sql(rx('html', '<title[^>]*>(.*?)</title>', 1, 'is'))} AS title FROM pages")
def _(spark, sf):
    return pages.html_text(load(spark, sf, "pages")).select("page_id", "text", "title")


_BASE = f"lower({url_part('p.url', 1)}) || '://' || {url_part('p.url', 2)}"


@query("html_link_scan", f"""WITH a AS (SELECT page_id, url, i, anchors[i] AS tag FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>') AS anchors FROM pages), unnest(range(1, len(anchors) + 1)) AS u(i)),
l AS (SELECT p.page_id, i, {strip_sql('tag')} AS title, {_BASE} || {_decode(rx('tag', 'href="([^"]*)"'))} AS link FROM a p), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY i) AS rn FROM l WHERE title <> '' AND link IS NOT NULL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, title, link AS url, {domain_sql('link')} AS domain FROM k WHERE rn = 1""")
def _(spark, sf):
    return pages.html_link_scan(load(spark, sf, "pages")).select("page_id", "pos", "title", "url", "domain")


_CARD = ("SELECT p_partkey AS page_id, concat('<html><body>', array_join(transform(sequence(1, 1 + p_size % 11), i -> concat('<div class=\"item-cell\"><a class=\"item-title\" href=\"https://shop.example.com/p/', cast(p_partkey AS string), '-', cast(i % 9 AS string), '\">', "
         "CASE WHEN i % 5 = 0 THEN '' ELSE concat(p_name, ' RTX ', cast(4000 + i AS string)) END, '</a><ul><li class=\"price-current\">$', cast(100 + i AS string), '.50</li></ul>', CASE WHEN i % 2 = 0 THEN 'Add to cart' ELSE 'Notify' END, CASE WHEN i % 3 = 0 THEN ' Free Shipping' ELSE '' END, '</div>')), ''), '</body></html>') AS html FROM {part}")


@query("html_card_scan", """WITH c AS (SELECT p_partkey AS page_id, i, CASE WHEN i % 5 = 0 THEN '' ELSE p_name || ' RTX ' || cast(4000 + i AS varchar) END AS title FROM part, unnest(range(1, 2 + p_size % 11)) AS u(i))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, title, '$' || cast(100 + i AS varchar) || '.50' AS price_text, CASE WHEN i % 2 = 0 THEN 'Available' ELSE 'Check Site' END AS inventory,
  CASE WHEN i % 3 = 0 THEN 'Free shipping' ELSE '' END AS promotion, 'https://shop.example.com/p/' || cast(page_id AS varchar) || '-' || cast(i % 9 AS varchar) AS url FROM c WHERE title <> ''""")
def _(spark, sf):
    shop = spark.sql(_CARD, part=load(spark, sf, "part"))
    return pages.html_card_scan(shop, "Newegg").select("page_id", "pos", "title", "price_text", "inventory", "promotion", "url")


_RESULTS = ("SELECT p_partkey AS page_id, concat('<html><div class=\"result\"><a class=\"result__a\" href=\"//duckduckgo.com/l/?uddg=https%3A%2F%2Fshop.example.com%2Fp%2F', cast(p_partkey AS varchar(20)), '&amp;rut=1\">', p_name, ' lot</a>"
            "<a class=\"result__snippet\">Price $', cast(p_size AS varchar(20)), ' &amp; up</a></div><div class=\"web-result result\"><a href=\"https://b.example.org/x/', cast(p_size AS varchar(20)), '\" class=\"result__a\">', p_type, "
            "'</a></div><div class=\"result\"><a class=\"result__a\" href=\"https://b.example.org/untitled\"></a></div></html>') AS html FROM {part}")


@query("html_result_scan", """SELECT p_partkey AS page_id, 0 AS pos, p_name || ' lot' AS title, 'https://shop.example.com/p/' || cast(p_partkey AS varchar) AS url, 'shop.example.com' AS domain, 'Price $' || cast(p_size AS varchar) || ' & up' AS snippet FROM part
UNION ALL SELECT p_partkey, 1, p_type, 'https://b.example.org/x/' || cast(p_size AS varchar), 'b.example.org', NULL FROM part""")
def _(spark, sf):
    return pages.html_result_scan(spark.sql(_RESULTS, part=load(spark, sf, "part"))).select("page_id", "pos", "title", "url", "domain", "snippet")


_SKU = ("SELECT p_partkey AS page_id, concat('<li class=\"sku-item\"><h4><a class=\"sku-title\" href=\"/site/', cast(p_partkey AS varchar(20)), '.p\">', p_name, '</a></h4><div class=\"priceView-customer-price\"><span>$', cast(p_size AS varchar(20)), '.99</span></div>Add to Cart Shipping Save</li>"
        "<li class=\"sku-item\"><a class=\"sku-title\" href=\"/site/', cast(p_partkey AS varchar(20)), '.p\">repeated</a></li><li class=\"product-flexbox\"><a class=\"sku-title\" href=\"https://www.bestbuy.com/x', cast(p_size AS varchar(20)), '\">', p_type, '</a>Sold Out Pickup</li>') AS html FROM {part}")


@query("sku_card_scan", """SELECT p_partkey AS page_id, 0 AS pos, p_name AS title, '$' || cast(p_size AS varchar) || '.99' AS price_text, 'Available' AS inventory, 'Sale' AS promotion, 'https://www.bestbuy.com/site/' || cast(p_partkey AS varchar) || '.p' AS url, true AS shipping, false AS pickup FROM part
UNION ALL SELECT p_partkey, 1, p_type, p_type || ' Sold Out Pickup', 'Out of Stock', '', 'https://www.bestbuy.com/x' || cast(p_size AS varchar), false, true FROM part""")
def _(spark, sf):
    return pages.html_card_scan(spark.sql(_SKU, part=load(spark, sf, "part")), "Best Buy").select("page_id", "pos", "title", "price_text", "inventory", "promotion", "url", "shipping", "pickup")


# ---------------------------------------------------------------- map files

@query("geojson_lines_scan", f"""WITH {cte('line_vertex')}, c AS (SELECT line_id, avg(lat) AS la, avg(lon) AS lo, list((round(lat, 3), round(lon, 3)) ORDER BY seq) AS v FROM line_vertex GROUP BY line_id)
SELECT line_id, 0 AS part, round(la, 6) AS lat, round(lo, 6) AS lon, CASE WHEN line_id % 4 = 0 THEN 138.0::DOUBLE WHEN line_id % 4 = 1 THEN 69.0 END AS voltage_kv, 'Line ' || cast(line_id AS varchar) AS asset_name, 3 AS vertex_count FROM c WHERE line_id % 5 <> 4
UNION ALL SELECT line_id, 1, round(la, 6), round(lo, 6), CASE WHEN line_id % 4 = 0 THEN 138.0::DOUBLE WHEN line_id % 4 = 1 THEN 69.0 END, 'Line ' || cast(line_id AS varchar), 3 FROM c WHERE line_id % 5 = 3""")
def _(spark, sf):
    shapes = record(spark, sf, "line_vertex").groupBy("line_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("v"))
    key = F.col("line_id")
    line = F.to_json(F.transform("v", lambda p: F.array(p["x"], p["y"])))
    coordinates = F.when(key % 5 == 3, F.concat(F.lit("["), line, F.lit(","), line, F.lit("]"))).when(key % 5 == 4, F.lit("[1.0,2.0]")).otherwise(line)
    kind = F.when(key % 5 == 3, "MultiLineString").when(key % 5 == 4, "Point").otherwise("LineString")
    kv = F.when(key % 4 == 0, F.lit('"voltage_kv":138,')).when(key % 4 == 1, F.lit('"voltage_kv":0,"VOLTAGE":"69",')).when(key % 4 == 2, F.lit('"KV":"n/a",')).otherwise(F.lit(""))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit('},"properties":{'), kv,
                       F.lit('"LINE_NAME":"Line '), key.cast("string"), F.lit('"}}'))
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    features = geofiles.features_of(shapes.select("line_id", collection.alias("collection")), "collection")
    return geofiles.geojson_lines_scan(features).select(
        "line_id", "part", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "voltage_kv", "asset_name", F.size("vertices").alias("vertex_count"))


_POWER = "CASE asset_id % 6 WHEN 0 THEN 'line' WHEN 1 THEN 'pole' WHEN 2 THEN 'plant' WHEN 3 THEN 'substation' WHEN 4 THEN 'generator' ELSE 'minor_line' END"


@query("osm_elements_scan", f"""WITH {cte('asset')}, e AS (SELECT *, {_POWER} AS power FROM asset) SELECT 'node/' || cast(asset_id AS varchar) AS asset_id, CASE WHEN power IN ('line', 'minor_line') THEN 'transmission_line' WHEN power = 'pole' THEN 'tower' ELSE power END AS asset_type,
  round(CASE WHEN asset_id % 3 = 0 THEN lat + 0.5 ELSE lat END, 6) AS lat, round(lon, 6) AS lon, CASE asset_id % 4 WHEN 0 THEN 138.0::DOUBLE WHEN 1 THEN 345.0 WHEN 2 THEN NULL END AS voltage_kv FROM e WHERE power <> 'generator'""")
def _(spark, sf):
    c = F.col
    power = F.expr(_POWER)
    volt = F.when(c("asset_id") % 4 == 0, "138000;69000").when(c("asset_id") % 4 == 1, "345").when(c("asset_id") % 4 == 2, "n/a")
    drawn, own = c("asset_id") % 3 == 0, c("asset_id") % 3 == 1
    element = F.struct(
        F.lit("node").alias("type"), c("asset_id").alias("id"), F.when(own, c("lat")).alias("lat"), F.when(own, c("lon")).alias("lon"),
        F.when(~drawn & ~own, F.struct("lat", "lon")).alias("center"),
        F.when(drawn, F.array(F.struct("lat", "lon"), F.struct((c("lat") + 1).alias("lat"), c("lon").alias("lon")))).alias("geometry"),
        F.map_filter(F.create_map(F.lit("power"), power, F.lit("voltage"), volt), lambda k, v: v.isNotNull()).alias("tags"))
    documents = record(spark, sf, "asset").select(F.to_json(F.array(element)).alias("elements"))
    return geofiles.osm_elements_scan(documents).select("asset_id", "asset_type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "voltage_kv")


@query("manual_import", f"""SELECT event_id, 'https://h.example.com/lot/' || cast(user_id AS varchar) || '/' || cast(i AS varchar) AS source_url, 'https://h.example.com/lot/' || cast(user_id AS varchar) || '/' || cast(i AS varchar) AS original_title, 'lot of ' || event_type AS original_description
FROM events, unnest(range(0, event_id % 3)) AS u(i) UNION ALL SELECT event_id, 'manual://hardware-listing', 'Manual hardware listing', 'lot of ' || event_type FROM events WHERE event_id % 3 = 0""")
def _(spark, sf):
    n = F.col("event_id") % 3
    urls = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.concat(
        F.lit("https://h.example.com/lot/"), F.col("user_id").cast("string"), F.lit("/"), i.cast("string")))
    wanted = load(spark, sf, "events").select(
        "event_id", F.when(n > 0, urls).otherwise(F.array().cast("array<string>")).alias("urls"), F.concat(F.lit("lot of "), "event_type").alias("text"))
    return hits.manual_import(wanted).select("event_id", "source_url", "original_title", "original_description")


# ---------------------------------------------------------------- detail pages

@query("http_outcome_status", f"""WITH {cte('http_response')} SELECT event_id, CASE WHEN timed_out OR error IS NOT NULL THEN 'needs_manual_review' WHEN http_status = 404 THEN 'removed' WHEN http_status >= 400 THEN 'unavailable' WHEN {has("lower(coalesce(body, ''))", rules.BLOCKED_PAGE_TOKENS)} THEN 'needs_manual_review' END AS listing_status,
  CASE WHEN timed_out THEN 'detail_page_timeout' WHEN error IS NOT NULL THEN error[1:240] WHEN http_status >= 400 THEN 'HTTP ' || cast(http_status AS varchar) WHEN {has("lower(coalesce(body, ''))", rules.BLOCKED_PAGE_TOKENS)} THEN 'captcha_or_access_challenge' END AS unavailable_reason FROM http_response""")
def _(spark, sf):
    c = F.col
    verdict = classify.http_outcome(c("http_status"), c("body"), c("timed_out"), c("error"))
    return record(spark, sf, "http_response").withColumn("_v", verdict).select("event_id", "_v.listing_status", "_v.unavailable_reason")


_T = "a.text"
_ABS = "trim(coalesce(" + ", ".join(rx("a.text", p) for p in rules.END_TIME_PATTERNS) + "))"
_ZONES = "CASE zone " + " ".join(f"WHEN '{z}' THEN {h}" for z, h in rules.ZONE_OFFSET_HOURS.items()) + " END"
_LOCAL = "regexp_replace(raw, '\\s+[A-Z]{2,4}$', '')"
_PARSED = f"coalesce(try_strptime({_LOCAL}, '%b %d, %Y %I:%M %p'), try_strptime({_LOCAL}, '%B %d, %Y %I:%M %p'), try_strptime({_LOCAL}, '%m/%d/%Y %I:%M %p')) - INTERVAL 1 HOUR * ({_ZONES})"
_CD = "trim(" + rx("text", rules.COUNTDOWN_PATTERNS[0]) + ")"


def _unit(pattern: str) -> str:
    return f"try_cast({rx('lower(cd)', pattern)} AS BIGINT)"


_MIN = " + ".join(f"coalesce({_unit(p)}, 0) * {m}" for p, m in rules.COUNTDOWN_UNITS)


def signal_ctes(source: str) -> str:
    """CTEs x1 to ``sig``: time signals in the column ``text`` of a source with ``captured_at``."""
    return f"""x1 AS (SELECT a.*, lower(text) AS low, {_ABS} AS raw, {_CD} AS cd FROM {source} a), x2 AS (SELECT *, nullif(regexp_extract(raw, '\\s([A-Z]{{2,4}})$', 1), '') AS zone, CASE WHEN ({_MIN}) > 0 THEN {_MIN} END AS mins FROM x1),
x3 AS (SELECT *, raw IS NULL AND mins IS NOT NULL AS counted, CASE WHEN raw IS NOT NULL THEN {_PARSED} ELSE captured_at + INTERVAL 1 MINUTE * mins END AS end_time FROM x2),
x4 AS (SELECT *, CASE WHEN regexp_matches(low, {q(rules.SOLD_PATTERN)}) THEN 'sold' WHEN {has('low', rules.REMOVED_TEXT)} THEN 'removed' WHEN {has('low', rules.CLOSED_TEXT)} THEN 'ended' END AS worded,
  CASE WHEN end_time IS NULL THEN 'unknown' WHEN end_time <= captured_at THEN 'ended' WHEN end_time <= captured_at + INTERVAL 24 HOUR THEN 'ending_soon' ELSE 'active' END AS timed FROM x3),
sig AS (SELECT *, CASE WHEN counted THEN timed WHEN worded IS NOT NULL THEN worded ELSE timed END AS listing_status,
  CASE WHEN counted THEN 'countdown_estimated' WHEN worded IS NULL AND end_time IS NULL THEN 'unknown' WHEN raw IS NOT NULL THEN 'source_confirmed' END AS end_time_verification FROM x4)"""


_SIGNALS = f"WITH {cte('auction_text')}, {signal_ctes('auction_text')}"


def signals(spark, sf) -> DataFrame:
    return times.end_time_columns(record(spark, sf, "auction_text"), "text", "captured_at")


@query("end_time_signals", f"""{_SIGNALS} SELECT page_id, listing_status, end_time_verification, {stamp_sql('end_time')} AS end_time_utc, raw AS end_time_raw, CASE WHEN zone IN ({', '.join(q(z) for z in rules.ZONE_OFFSET_HOURS)}) THEN zone END AS end_time_timezone_raw,
  CASE WHEN counted THEN cd END AS countdown_raw_text, CASE WHEN counted THEN cd END AS time_remaining, CASE WHEN counted THEN {stamp_sql('captured_at')} END AS countdown_captured_at, CASE WHEN counted THEN {stamp_sql('end_time')} END AS calculated_end_time,
  CASE WHEN counted THEN 'captured_at_utc' END AS calculated_timezone, CASE WHEN counted THEN 'medium' END AS calculation_confidence FROM sig""")
def _(spark, sf):
    return signals(spark, sf).select(
        "page_id", "listing_status", "end_time_verification", stamp("end_time_utc"), "end_time_raw", "end_time_timezone_raw", "countdown_raw_text", "time_remaining",
        stamp("countdown_captured_at"), stamp("calculated_end_time"), "calculated_timezone", "calculation_confidence")


@query("finalize_status", f"""{_SIGNALS} SELECT page_id, CASE WHEN end_time IS NOT NULL AND listing_status = 'unknown' THEN timed WHEN end_time IS NULL AND listing_status = 'unknown' AND unavailable_reason IS NOT NULL THEN 'needs_manual_review'
  WHEN end_time IS NOT NULL AND listing_status IN ('active', 'ending_soon') AND timed = 'ended' THEN 'ended' ELSE listing_status END AS listing_status,
  end_time IS NULL AND listing_status = 'unknown' AND unavailable_reason IS NOT NULL AS needs_manual_review FROM sig""")
def _(spark, sf):
    return pages.finalized(signals(spark, sf)).select("page_id", "listing_status", "needs_manual_review")


_ENDED_RAW = rx("text", r"Auction Ended\s+(" + rules.LONG_DATE + ")", 1, "c")
_PLACE = r"Pick-up Location.+?\[\s*(.+?)\s+([A-Za-z .'-]+),\s*([A-Z]{2})\s+(\d{5})\s*\]"
_MONEY = r"\s*:?\s*\$?\s*([0-9][0-9,]*(?:\.\d{2})?)"
_PRICE = "coalesce(" + ", ".join(num(rx("text", label + _MONEY)) for label in ("Current Price", "High Bid", "Final Price", "Minimum bid")) + ")"


@query("public_auction_detail", f"""{_SIGNALS} SELECT page_id, CASE WHEN counted THEN listing_status WHEN {_ENDED_RAW} IS NOT NULL THEN 'ended' ELSE listing_status END AS listing_status, regexp_extract(source_url, 'auc=([^&]+)', 1) AS lot_number,
  trim({rx('text', 'Auction #?([0-9]+) - (.+?)(?:Auction Extended|Auction Started|Auction Ended|Pick-up Location|# of Bids)', 2)}) AS title, {_PRICE} AS current_price, try_cast({rx('text', '# of Bids *:? *([0-9]+)')} AS BIGINT) AS bid_count,
  trim({rx('text', _PLACE, 2)}) AS location_city, {rx('text', _PLACE, 3)} AS location_state, {rx('text', _PLACE, 4)} AS zip_code, {has('low', ['buyer must pickup', 'local pickup'])} AS pickup_only,
  contains(low, 'shipping options') AND contains(low, 'freight') AS shipping_available, coalesce(nullif(trim(regexp_extract(text, 'View (.*?) Auctions', 1)), ''), 'Public Surplus seller') AS seller_name FROM sig""")
def _(spark, sf):
    return pages.public_auction_detail(record(spark, sf, "auction_text")).select(
        "page_id", "listing_status", "lot_number", "title", "current_price", "bid_count", "location_city", "location_state", "zip_code", "pickup_only", "shipping_available", "seller_name")


@query("spa_shell_detail", f"""{_SIGNALS} SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'Listing ' || cast(page_id % 7 AS varchar) END AS title, listing_status, CASE WHEN end_time IS NOT NULL THEN 'secondary_source_confirmed' ELSE end_time_verification END AS end_time_verification,
  end_time IS NULL AS needs_manual_review FROM sig""")
def _(spark, sf):
    page = F.col("page_id")
    shells = record(spark, sf, "auction_text").withColumns({
        "original_title": F.when(page % 3 != 0, F.concat(F.lit("Listing "), (page % 7).cast("string"))).otherwise("GovDeals"), "original_description": F.col("text")})
    return pages.spa_shell_detail(shells, "GovDeals").select("page_id", "title", "listing_status", "end_time_verification", "needs_manual_review")


