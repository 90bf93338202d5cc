"""One query per group of column functions."""

from pyspark.sql import functions as F

from dealsift import rules
from dealsift.catalog import hardware as H
from dealsift.catalog import sites as S
from dealsift.catalog.records import cte, load, record
from dealsift.catalog.registry import distinct_list, flags, has, haversine_sql, joined, joined_sql, num, q, query, rx, url_part
from dealsift.functions import address, amount, geo, labels, text, times, url

_K = H.KEYS_SQL


@query("fn_url", f"""{H.LISTED}, f AS (SELECT *, CASE WHEN scheme <> '' THEN lower(scheme) || ':' ELSE '' END || '//' || domain || regexp_replace(path, '/+$', '') AS plain FROM canon)
SELECT {_K}, canonical_url, domain, plain AS without_query, lower(scheme) || '://' || {url_part('source_url', 2)} AS root,
  CASE WHEN regexp_replace(path, '/+$', '') <> '' THEN string_split(regexp_replace(path, '/+$', ''), '/')[-1] END AS listing_id FROM f""")
def _(spark, sf):
    link = F.col("source_url")
    return record(spark, sf, "listing_src").select(
        *H.KEYS, url.canonical(link).alias("canonical_url"), url.domain(link).alias("domain"), url.without_query(link).alias("without_query"),
        url.root(link).alias("root"), url.listing_id(link).alias("listing_id"))


_MONEY = r"\s*:?\s*\$?\s*([0-9][0-9,]*(?:\.\d{2})?)"


@query("fn_money", f"""{S.NORM} SELECT hit_no, {num(rx('text', rules.DOLLAR_PATTERN))} AS first_price, asking_price_usd AS site_price, price_status, {num(rx('text', rules.RETAIL_PRICE_PATTERN))} AS parsed_price,
  coalesce({num(rx('text', 'acres' + _MONEY))}, {num(rx('text', 'warehouse' + _MONEY))}) AS labelled FROM norm""")
def _(spark, sf):
    body = text.text_of(F.col("original_title"), F.col("original_description"))
    rows = record(spark, sf, "site_src").withColumn("t", body)
    t = F.col("t")
    priced = rows.withColumn("site_price", amount.site_price(t))
    return priced.select(
        "hit_no", amount.first_price(t).alias("first_price"), "site_price", amount.price_status(t, F.col("site_price")).alias("price_status"),
        amount.parse_price(t).alias("parsed_price"), amount.money_after(t, ["acres", "warehouse"]).alias("labelled"))


@query("fn_number", f"""{H.SPEC} SELECT {_K}, quantity, buyer_premium, try_cast({rx('text', 'qty *:? *([0-9]+)')} AS BIGINT) AS after_qty, CASE WHEN regexp_matches(text, '\\b(dual|2x|qty\\s*2)\\b', 'i') THEN 2 END AS pair, amount * 2 AS doubled FROM norm""")
def _(spark, sf):
    rows = H.hits_of(spark, sf, "spec_src").withColumn("t", text.text_of(F.col("original_title"), F.col("original_description")))
    t = F.col("t")
    return rows.select(
        *H.KEYS, amount.quantity(t).alias("quantity"), amount.buyer_premium(t).alias("buyer_premium"), amount.int_after(t, "qty").alias("after_qty"),
        amount.two_if_present(t, r"\b(?:dual|2x|qty\s*2)\b").alias("pair"),
        (amount.float_or_none(F.concat(F.lit("$"), F.col("amount").cast("string"))) * amount.int_or_none(F.lit("2"))).alias("doubled"))


@query("fn_units", f"""{S.NORM} SELECT hit_no, land_acres, building_sqft, CASE hit_no % 4 WHEN 0 THEN 138.0 WHEN 1 THEN 345.0 WHEN 2 THEN NULL ELSE round((1001 + hit_no) / 1000.0, 3) END::DOUBLE AS voltage_kv,
  CASE WHEN hit_no % 2 = 0 THEN (hit_no % 9)::DOUBLE ELSE round((100 + hit_no % 900)::DOUBLE / 1024, 3) END AS capacity_tb FROM norm""")
def _(spark, sf):
    k = F.col("hit_no")
    t = text.text_of(F.col("original_title"), F.col("original_description"))
    volts = F.when(k % 4 == 0, "138000;69000").when(k % 4 == 1, "345").when(k % 4 == 2, "n/a").otherwise((k + 1001).cast("string"))
    disk = F.when(k % 2 == 0, F.concat((k % 9).cast("string"), F.lit(" TB"))).otherwise(F.concat((100 + k % 900).cast("string"), F.lit("GB")))
    return record(spark, sf, "site_src").select(
        "hit_no", amount.land_acres(t).alias("land_acres"), amount.building_sqft(t).alias("building_sqft"),
        amount.osm_voltage_kv(volts).alias("voltage_kv"), amount.capacity_tb(disk).alias("capacity_tb"))


_BRAND = "CASE " + " ".join(f"WHEN contains(low, {q(b.lower())}) THEN {q(b)}" for b in rules.KNOWN_BRANDS) + " END"


@query("fn_product", f"{H.SPEC} SELECT {_K}, manufacturer, model, subcategory, part_number, generation, configuration, {_BRAND} AS brand, coalesce({', '.join(f'trim({rx(chr(116) + chr(101) + chr(120) + chr(116), p, 0)})' for p in rules.RETAIL_MODEL_PATTERNS)}) AS retail_model FROM norm")
def _(spark, sf):
    t = text.text_of(F.col("title"), F.col("raw_description"))
    return H.normalized(spark, sf, "spec_src").select(
        *H.KEYS, "manufacturer", "model", "subcategory", "part_number", "generation", "configuration", amount.brand(t).alias("brand"), amount.retail_model(t).alias("retail_model"))


@query("fn_address", f"{S.NORM} SELECT hit_no, address_line_1, csz_city, state, zip_code, address_status, broker_company FROM norm")
def _(spark, sf):
    rows = record(spark, sf, "site_src").withColumn("t", text.text_of(F.col("original_title"), F.col("original_description")))
    t = F.col("t")
    placed = rows.withColumns({"address_line_1": address.street_address(t), "_p": address.city_state_zip(t)})
    known = F.coalesce(address.city_after_address(t, F.col("address_line_1")), F.col("_p.city"))
    return placed.select(
        "hit_no", "address_line_1", F.col("_p.city").alias("csz_city"), F.col("_p.state").alias("state"), F.coalesce("_p.zip_code", address.zip_code(t)).alias("zip_code"),
        address.address_status(F.col("address_line_1"), known, F.col("_p.state")).alias("address_status"), address.broker_company(t).alias("broker_company"))


@query("fn_contact", f"""SELECT doc_id, {rx('text', rules.EMAIL_PATTERN, 0)} AS email, {rx('text', rules.PHONE_PATTERN, 0)} AS phone FROM documents WHERE regexp_matches(text, {q(rules.EMAIL_PATTERN)}) OR regexp_matches(text, {q(rules.PHONE_PATTERN)})""")
def _(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", address.email(F.col("text")).alias("email"), address.phone(F.col("text")).alias("phone"))
    return found.filter(F.col("email").isNotNull() | F.col("phone").isNotNull())


@query("fn_text", f"""WITH d AS (SELECT page_id, html, strpos(lower(html), '<article>') AS place FROM pages) SELECT page_id, CASE WHEN place > 0 THEN substr(html, place, 60) ELSE '' END AS sliced,
  trim(nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '')) AS between_text, trim(regexp_replace({rx('html', 'charset=[^>]*', 0)}, '\\s+', ' ', 'g')) AS matched, {has('lower(html)', ['nicht', 'para'])} AS mentions FROM d""")
def _(spark, sf):
    h = F.col("html")
    return load(spark, sf, "pages").select(
        "page_id", text.slice_after(h, "<ARTICLE>", 60).alias("sliced"), text.between(h, "<title>", "</title>").alias("between_text"),
        text.first_match(h, "charset=[^>]*").alias("matched"), text.contains_any(F.lower(h), ["nicht", "para"]).alias("mentions"))


@query("fn_date", f"""WITH {cte('tracked')} SELECT event_id, CASE WHEN end_time_utc IS NULL THEN 'unknown' WHEN end_time_utc <= observed_at THEN 'ended' WHEN end_time_utc <= observed_at + INTERVAL 24 HOUR THEN 'ending_soon' ELSE 'active' END AS status,
  strftime(end_time_utc - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS user_time, strftime(observed_at - INTERVAL 16 HOUR, '%Y-%m-%d') AS report_day, cast(event_id % 3 * 1440 + event_id % 20 * 60 AS BIGINT) AS minutes FROM tracked""")
def _(spark, sf):
    c = F.col
    countdown = F.concat((c("event_id") % 3).cast("string"), F.lit(" d "), (c("event_id") % 20).cast("string"), F.lit(" h"))
    return record(spark, sf, "tracked").select(
        "event_id", times.status_from_end(c("end_time_utc"), c("observed_at")).alias("status"), times.user_time(c("end_time_utc")).alias("user_time"),
        times.report_day(times.iso_datetime(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("string").alias("report_day"), times.countdown_minutes(countdown).alias("minutes"))


@query("fn_geo", f"""WITH {cte('site')} SELECT site_id, round({haversine_sql('lat', 'lon', '34.1868601673', '-83.783076145055')}, 3) AS miles, CASE WHEN site_id % 2 = 0 OR lon < -125 THEN lat ELSE lat END AS lat, lon FROM site WHERE lon >= -125""")
def _(spark, sf):
    c = F.col
    mixed = F.when(c("site_id") % 2 == 0, F.struct(c("lat").alias("a"), c("lon").alias("b"))).otherwise(F.struct(c("lon").alias("a"), c("lat").alias("b")))
    rows = record(spark, sf, "site").filter(c("lon") >= -125).withColumn("_m", mixed).withColumn("_p", geo.normalize_pair(F.col("_m.a"), F.col("_m.b")))
    miles = geo.haversine_miles(c("lat"), c("lon"), F.lit(34.1868601673), F.lit(-83.783076145055))
    return rows.select("site_id", F.round(miles, 3).alias("miles"), F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))


@query("fn_hash_json", "SELECT event_id, sha256(event_type || cast(user_id AS varchar)) AS hash, cast(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || cast(event_id AS varchar) || ',\"event_type\":\"' || event_type || '\"}' AS payload FROM events")
def _(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", F.sha2(F.concat("event_type", F.col("user_id").cast("string")), 256).alias("hash"),
        F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("payload"))


@query("fn_format", """SELECT o_orderkey, '$' || format('{:,.0f}', floor(o_totalprice)) AS money, format('{:,.2f}', o_custkey / 4.0) || ' mi' AS miles, cast(o_custkey % 101 AS varchar) || '%' AS percent, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_custkey % 5 = 0 THEN 'verify' ELSE '$' || format('{:,.0f}', o_custkey::DOUBLE) END AS shown FROM orders""")
def _(spark, sf):
    c = F.col
    return load(spark, sf, "orders").select(
        "o_orderkey", labels.money(F.floor("o_totalprice").cast("double")).alias("money"), labels.miles(c("o_custkey") / 4).alias("miles"),
        labels.percent((c("o_custkey") % 101) / 100).alias("percent"), labels.date_or_verify(c("o_orderdate")).alias("day"),
        labels.money_or_verify(F.when(c("o_custkey") % 5 == 0, F.lit(0.0)).otherwise(c("o_custkey").cast("double"))).alias("shown"))


@query("fn_array_map", f"""WITH w AS (SELECT event_id, {flags([("event_id % 2 = 0", "even"), ("event_type = 'click'", "click"), ("event_id % 3 = 0", "even"), ("value > 50", "large")])} AS f FROM events)
SELECT event_id, {joined_sql('f')} AS all_flags, {joined_sql(distinct_list('f'))} AS distinct_flags, list_contains(f, 'large') AS is_large FROM w""")
def _(spark, sf):
    c = F.col
    made = text.strings(F.when(c("event_id") % 2 == 0, "even"), F.when(c("event_type") == "click", "click"), F.when(c("event_id") % 3 == 0, "even"), F.when(c("value") > 50, "large"))
    return load(spark, sf, "events").withColumn("f", made).select(
        "event_id", joined("f", "all_flags"), joined(F.array_distinct("f"), "distinct_flags"), F.array_contains("f", "large").alias("is_large"))
