"""Site listing queries."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog.records import cte, record
from dealsift.catalog.registry import (domain_sql, flags, has, haversine_sql, hit, in_list, joined, joined_sql, num, path_sql, q, query, rx,
                                       url_part)
from dealsift.functions import url
from dealsift.operators import classify, discovery, funnel, lifecycle, retail, sites
from dealsift.operators.dedupe import ranked_per_group
from dealsift.plans import scans

ORDER = ["fetched_at", "hit_no"]
_CODES = "|".join(c for c, _, _ in rules.US_STATES)
_NAMES = "|".join(n for _, n, _ in rules.US_STATES)
_CASE = "CASE {x} " + " ".join(f"WHEN '{c}' THEN {q(n)}" for c, n, _ in rules.US_STATES) + " END"
_WORD = rules.CITY_WORD
_CSZ = rf"\b({_WORD}(?:\s+{_WORD})?)\s*,?\s+({_CODES}),?\s+(\d{{5}}(?:-\d{{4}})?)\b"


def _clean(x: str) -> str:
    words = "|".join(rules.ROAD_WORDS)
    return f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^(?:\\.*(?:{words})\\.* )+', '', 'i')"


def norm_sql(src: str = "site_src") -> str:
    # the number may not follow a digit or a comma: written without a look-behind here
    highway = rx("text", r"(?:^|[^\d,])" + rules.HIGHWAY_PATTERN)
    street = rx("text", r"(?:^|[^\d,])" + rules.STREET_PATTERN)
    address = f"trim(coalesce({rx('text', rules.COUNTY_ROAD_PATTERN)}, {highway}, {street}))"
    tail = "substr(text, strpos(text, address_line_1) + length(address_line_1))"
    after = rf"^\s+({_WORD}(?:\s+{_WORD}){{0,2}}),?\s+({_CODES})\b"
    broker = rules.BROKER_PREFIX + r"([^|\n]+?)" + rules.BROKER_SUFFIX
    contact = has("low", rules.CONTACT_PRICE_TEXT)
    return f"""{cte(src)}, s0 AS (SELECT *, original_title || ' ' || coalesce(original_description, '') AS text, lower(original_title || ' ' || coalesce(original_description, '')) AS low FROM {src}),
s1 AS (SELECT *, {address} AS address_line_1, {_clean(rx('text', _CSZ, 1, 'c'))} AS csz_city, {_CASE.format(x=rx('text', _CSZ, 2, 'c'))} AS state, {rx('text', _CSZ, 3, 'c')} AS csz_zip,
  coalesce({num(rx('text', rules.FULL_PRICE_PATTERN))}, {num(rx('text', rules.MILLION_PRICE_PATTERN))} * 1000000) AS asking_price_usd,
  {num(rx('text', rules.ACRES_PATTERN))} AS land_acres, {num(rx('text', rules.SQFT_PATTERN))} AS building_sqft,
  CASE WHEN {has('low', ['manufacturing', 'factory'])} THEN 'manufacturing facility' WHEN contains(low, 'warehouse') THEN 'warehouse' WHEN {has('low', ['industrial land', 'acre'])} THEN 'industrial land'
    WHEN contains(low, 'industrial') THEN 'industrial property' END AS property_type,
  trim({rx('text', broker)})[1:120] AS broker_company FROM s0),
s2 AS (SELECT *, coalesce(CASE WHEN address_line_1 IS NOT NULL THEN {_clean(rx(tail, after, 1, 'c'))} END, csz_city) AS known_city, coalesce(csz_zip, {rx('text', rules.ZIP_PATTERN, 0)}) AS zip_code,
  CASE WHEN asking_price_usd <> 0 THEN 'asking_price' WHEN {contact} THEN 'contact_for_price' ELSE 'unknown' END AS price_status FROM s1),
s3 AS (SELECT *, coalesce(known_city, {rx('text', rf'{chr(92)}b({_WORD}(?:{chr(92)}s+{_WORD})?){chr(92)}s*,{chr(92)}s*({_NAMES}){chr(92)}b', 1, 'c')}) AS city,
  CASE WHEN address_line_1 IS NOT NULL AND known_city IS NOT NULL AND state IS NOT NULL THEN 'full' WHEN address_line_1 IS NOT NULL OR known_city IS NOT NULL OR state IS NOT NULL THEN 'partial' ELSE 'unknown' END AS address_status FROM s2),
norm AS (SELECT *, round((1 + 1 + (state IS NOT NULL)::int + (city IS NOT NULL)::int + (address_line_1 IS NOT NULL)::int + coalesce(land_acres <> 0, false)::int + coalesce(building_sqft <> 0, false)::int
  + (coalesce(asking_price_usd <> 0, false) OR price_status = 'contact_for_price')::int + (property_type IS NOT NULL)::int + (broker_company IS NOT NULL)::int) / 10.0, 2)::DOUBLE AS data_completeness_score,
  {flags([('address_line_1 IS NULL', 'address'), ('land_acres IS NULL', 'land_acres'), ('building_sqft IS NULL', 'building_sqft'), ('asking_price_usd IS NULL', 'asking_price_usd'), ('true', 'zoning')])} AS missing_fields,
  {domain_sql('lower(source_url)')} AS domain, regexp_replace({path_sql('lower(source_url)')}, '/+$', '') AS path FROM s3)"""


def _category_sql() -> str:
    real = has("low", rules.REAL_ESTATE_TOKENS)
    irrelevant = (f"{has('domain', rules.SITE_IRRELEVANT_DOMAINS)} OR {has('low', rules.SITE_IRRELEVANT_TEXT)} OR (contains(low, 'businesses for sale') AND NOT {real}) "
                  f"OR ({has('domain', rules.SITE_BUSINESS_DOMAINS)} AND NOT {real})")
    cpath, ctext = has("path", rules.SITE_COLLECTION_PATHS), has("low", rules.SITE_COLLECTION_TEXT)
    specific = (f"(contains(domain, 'commercial.century21.com') AND contains(path, '/listing/')) OR (contains(domain, 'crexi.com') AND {hit('path', '/properties/[0-9]+')}) "
                f"OR ({has('path', ['/listing/', '/property/'])} AND NOT {cpath}) OR (address_line_1 IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL "
                f"AND (coalesce(land_acres, 0) <> 0 OR coalesce(building_sqft, 0) <> 0 OR coalesce(asking_price_usd, 0) <> 0) AND NOT {ctext})")
    collection = f"{cpath} OR {ctext} OR {has('domain', rules.SITE_COLLECTION_DOMAINS)} OR (contains(domain, 'crexi.com') AND contains(path, '/properties/'))"
    return f"CASE WHEN {irrelevant} THEN 'irrelevant' WHEN {specific} THEN 'specific_listing' WHEN {collection} THEN 'listing_collection' ELSE 'source_page' END"


_NOQUERY = (f"CASE WHEN {url_part('source_url', 1)} <> '' THEN lower({url_part('source_url', 1)}) || ':' ELSE '' END || CASE WHEN {domain_sql('source_url')} <> '' THEN '//' || {domain_sql('source_url')} ELSE '' END "
            f"|| regexp_replace({path_sql('source_url')}, '/+$', '')")
_Q = flags([("result_category = 'specific_listing' AND coalesce(land_acres, 0) = 0", "needs_verification: land_acres unknown"),
            ("result_category = 'specific_listing' AND address_line_1 IS NULL", "needs_verification: address unknown"),
            ("result_category = 'specific_listing' AND coalesce(asking_price_usd, 0) = 0", "needs_verification: price unknown"),
            ("result_category = 'listing_collection'", "not_formal_candidate: listing_collection"), ("result_category = 'source_page'", "not_formal_candidate: source_page")])
NORM = f"WITH {norm_sql()}"
CLASSED = f"{NORM}, classed AS (SELECT *, {_category_sql()} AS result_category FROM norm)"
JUDGED = f"""{CLASSED}, {cte('site_criteria')}, m AS (SELECT l.*, CASE WHEN result_category = 'irrelevant' THEN 'irrelevant' WHEN target_state IS NOT NULL AND state IS NOT NULL AND state <> target_state THEN 'state_mismatch'
    WHEN result_category = 'specific_listing' AND land_acres < min_land_acres THEN 'size_mismatch' WHEN result_category = 'specific_listing' AND asking_price_usd > max_price_usd THEN 'budget_mismatch' END AS reason,
  CASE WHEN result_category = 'specific_listing' THEN 'final' ELSE 'discovery' END AS shelf,
  CASE WHEN result_category = 'specific_listing' AND address_line_1 IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL THEN lower(address_line_1 || '|' || city || '|' || state) ELSE {_NOQUERY} END AS dedupe_key
  FROM classed l LEFT JOIN site_criteria c USING (job_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, shelf, reason IS NULL, dedupe_key ORDER BY fetched_at, hit_no) AS rn FROM m),
judged AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN rn = 1 THEN shelf ELSE 'duplicate' END AS disposition FROM r)"""


def _score_sql(src: str) -> str:
    zero = "ELSE 0 END"
    return f"""scored AS (SELECT *, cast(least(100, CASE WHEN property_type IS NOT NULL THEN 20 {zero} + CASE WHEN land_acres >= 20 THEN 15 WHEN land_acres <> 0 THEN 8 {zero}
  + CASE WHEN state IS NOT NULL OR city IS NOT NULL OR zip_code IS NOT NULL THEN 10 {zero} + CASE WHEN asking_price_usd <> 0 THEN 10 {zero} + 10 + 10 + greatest(0, 10 - len(missing_fields))) AS double) AS preliminary_score FROM {src})"""


_GRADE = "CASE WHEN preliminary_score >= 80 THEN 'A' WHEN preliminary_score >= 65 THEN 'B' WHEN preliminary_score >= 45 THEN 'C' ELSE 'D' END"
_REASONS = f"""list_filter([CASE WHEN property_type IS NOT NULL THEN 'Industrial property type identified: ' || property_type END, CASE WHEN land_acres <> 0 THEN 'Land acreage found: ' || cast(cast(land_acres AS bigint) AS varchar) || ' acres' END,
  CASE WHEN state IS NOT NULL OR city IS NOT NULL OR zip_code IS NOT NULL THEN 'Regional location information found' END, CASE WHEN asking_price_usd <> 0 THEN 'Asking price extracted: $' || format('{{:,.0f}}', asking_price_usd) END,
  'Source description or search snippet retained', 'Original source URL retained'], lambda x: x IS NOT NULL)"""


# ---------------------------------------------------------------- inputs

def hits(spark, sf) -> DataFrame:
    return record(spark, sf, "site_src")


def normal(spark, sf) -> DataFrame:
    return sites.normalize_site(hits(spark, sf))


def criteria(spark, sf) -> DataFrame:
    return record(spark, sf, "site_criteria").withColumn(
        "states", F.when(F.col("target_state").isNotNull(), F.array("target_state")).otherwise(F.array().cast("array<string>")))


def judged(spark, sf) -> DataFrame:
    return scans.site_candidates(hits(spark, sf), criteria(spark, sf), ORDER)


_FIELDS = ["address_line_1", "city", "state", "zip_code", "land_acres", "building_sqft", "asking_price_usd", "property_type", "broker_company", "address_status", "price_status"]


@query("normalize_site", f"{NORM} SELECT hit_no, {', '.join(_FIELDS)} FROM norm")
def _(spark, sf):
    return normal(spark, sf).select("hit_no", *_FIELDS)


@query("completeness", f"{NORM} SELECT hit_no, data_completeness_score, {joined_sql('missing_fields')} AS missing_fields FROM norm")
def _(spark, sf):
    return normal(spark, sf).select("hit_no", "data_completeness_score", joined("missing_fields"))


_TRUST = {"land_acres": "coalesce(land_acres, 0) <> 0", "asking_price_usd": "coalesce(asking_price_usd, 0) <> 0", "address": "address_line_1 IS NOT NULL", "city": "city IS NOT NULL", "state": "state IS NOT NULL"}


@query("field_confidence", f"{NORM} SELECT hit_no, 'title=source_confirmed|source_url=source_confirmed|' || " + " || '|' || ".join(
    f"'{f}=' || CASE WHEN {c} THEN 'source_confirmed' ELSE 'unknown' END" for f, c in _TRUST.items()) + " || '|zoning=unknown' AS field_confidence FROM norm")
def _(spark, sf):
    entries = F.transform(F.map_entries("field_confidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return normal(spark, sf).select("hit_no", joined(entries, "field_confidence"))


@query("classify_site_result", f"{CLASSED} SELECT hit_no, result_category FROM classed")
def _(spark, sf):
    return sites.classify_sites(normal(spark, sf)).select("hit_no", "result_category")


@query("quality_flags", f"{CLASSED} SELECT hit_no, {joined_sql(_Q)} AS quality_flags FROM classed")
def _(spark, sf):
    return sites.classify_sites(normal(spark, sf)).select("hit_no", joined("quality_flags"))


_GROUP = "CASE hit_no % 4 WHEN 0 THEN 'economic_development' WHEN 1 THEN 'local_brokerage' ELSE 'property_market' END"
_HAYSTACK = f"lower({domain_sql('source_url')} || ' ' || original_title || ' ' || original_description)"
_PUBLIC = "(contains(domain, '.gov') OR contains(hay, 'government'))"


_SOURCE_TYPE = f"""CASE WHEN {_PUBLIC} AND contains(hay, 'county') THEN 'county_government' WHEN {_PUBLIC} AND contains(hay, 'city') THEN 'city_government' WHEN {_PUBLIC} THEN 'state_government'
  WHEN {has('hay', ['utility', 'electric', 'power'])} THEN 'utility' WHEN contains(hay, 'industrial park') THEN 'industrial_park' WHEN {has('hay', ['economic development', 'development corporation'])} THEN 'economic_development'
  WHEN {has('hay', ['broker', 'real estate'])} OR grp = 'local_brokerage' THEN 'local_brokerage' WHEN contains(hay, 'auction') THEN 'auction' ELSE 'other' END"""
_TRUSTED = f"CASE WHEN contains(domain, '.gov') OR grp IN {in_list(rules.TRUSTED_SOURCE_GROUPS)} THEN 'source_confirmed' ELSE 'unverified' END"
_SOURCED = f"WITH {cte('site_src')}, h AS (SELECT *, {_GROUP} AS grp, {domain_sql('source_url')} AS domain, {_HAYSTACK} AS hay FROM site_src)"


def _grouped(spark, sf) -> DataFrame:
    no = F.col("hit_no") % 4
    group = F.when(no == 0, "economic_development").when(no == 1, "local_brokerage").otherwise("property_market")
    return hits(spark, sf).withColumns({"source_group": group, "domain": url.domain(F.col("source_url"))})


@query("classify_source", f"{_SOURCED} SELECT hit_no, {_SOURCE_TYPE} AS source_type, {_TRUSTED} AS trust_level FROM h")
def _(spark, sf):
    c = F.col
    return _grouped(spark, sf).select(
        "hit_no", classify.source_type(c("domain"), c("original_title"), c("original_description"), c("source_group")).alias("source_type"),
        classify.trust_level(c("domain"), c("source_group")).alias("trust_level"))


_SEED = " UNION ALL ".join(f"SELECT {q(n)}, {q(d)}, '{t}', 'source_confirmed', 'seeded_national_source'" for n, d, t in rules.SEEDED_SOURCES)


@query("new_domain_antijoin", f"""{_SOURCED}, known AS (SELECT concat('broker', cast(n_nationkey AS varchar), '.example.com') AS domain FROM nation), f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY fetched_at, hit_no) AS rn FROM h
  WHERE domain NOT IN (SELECT domain FROM known) AND domain NOT IN {in_list(d for _, d, _ in rules.SEEDED_SOURCES)})
SELECT original_title AS source_name, domain, {_SOURCE_TYPE} AS source_type, {_TRUSTED} AS trust_level, 'web_search:' || source_name AS discovery_method FROM f WHERE rn = 1 UNION ALL {_SEED}""")
def _(spark, sf):
    found = _grouped(spark, sf).withColumns({"title": F.col("original_title"), "snippet": F.col("original_description"), "query": F.col("source_name")})
    known = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("broker"), "n_nationkey", F.lit(".example.com")).alias("domain"))
    return discovery.new_domains(found, known, ORDER)


_BIZ = f"(contains(low, 'businesses for sale') AND NOT {has('low', rules.REAL_ESTATE_TOKENS)})"


@query("site_relevance", f"{NORM} SELECT hit_no, source_url FROM norm WHERE NOT {has('domain', rules.SITE_BLOCKED_DOMAINS)} AND NOT {_BIZ} AND {has('low', rules.SITE_WANTED)}")
def _(spark, sf):
    return classify.site_relevance(_grouped(spark, sf)).select("hit_no", "source_url")


@query("criteria_filter", f"""{JUDGED} SELECT hit_no, job_id, result_category FROM m WHERE reason IS NULL OR reason = 'irrelevant' AND NOT (target_state IS NOT NULL AND state IS NOT NULL AND state <> target_state)""".replace("SELECT l.*,", "SELECT l.*, target_state,"))
def _(spark, sf):
    return sites.criteria_filter(sites.classify_sites(normal(spark, sf)), criteria(spark, sf)).select("hit_no", "job_id", "result_category")


_COUNTS = {"specific_listings": "result_category = 'specific_listing'", "listing_collections": "result_category = 'listing_collection'", "source_pages": "result_category = 'source_page'",
           "irrelevant_results": "result_category = 'irrelevant'", "state_mismatch_removed": "disposition = 'state_mismatch'", "size_mismatch_removed": "disposition = 'size_mismatch'",
           "budget_mismatch_removed": "disposition = 'budget_mismatch'", "duplicates_removed": "disposition = 'duplicate'", "final_candidates": "disposition = 'final'", "discovery_candidates": "disposition = 'discovery'"}


@query("site_funnel", f"{JUDGED} SELECT job_id, count(*) AS raw_results, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _COUNTS.items())} FROM judged GROUP BY job_id")
def _(spark, sf):
    return funnel.site_funnel(judged(spark, sf), ("job_id",))


_REGIONS = """region_name, count(*) AS raw_result_count, count(*) FILTER (disposition IN ('final', 'discovery')) AS specific_listing_count, count(*) FILTER (disposition = 'final') AS final_candidate_count, 0 AS power_screened_count"""


@query("region_funnel", f"{JUDGED} SELECT {_REGIONS} FROM judged WHERE region_name IS NOT NULL GROUP BY region_name")
def _(spark, sf):
    return funnel.region_funnel(judged(spark, sf))


@query("region_fact_join", f"""{JUDGED}, facts AS (SELECT {_REGIONS} FROM judged WHERE region_name IS NOT NULL GROUP BY region_name), regions AS (SELECT 'Region ' || cast(n_nationkey AS varchar) AS region_name FROM nation)
SELECT region_name, coalesce(raw_result_count, 0) AS raw_result_count, coalesce(final_candidate_count, 0) AS final_candidate_count, CASE WHEN raw_result_count > 0 THEN 'success' ELSE 'pending' END AS status FROM regions LEFT JOIN facts USING (region_name)""")
def _(spark, sf):
    regions = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("Region "), "n_nationkey").alias("region_name"))
    joined_facts = funnel.region_fact_join(regions, funnel.region_funnel(judged(spark, sf)))
    return joined_facts.select("region_name", "raw_result_count", "final_candidate_count", "status")


_ASKED_REGIONS = "SELECT concat('Region ', cast(c_nationkey AS varchar(20))) AS region_name, c_custkey AS query_no FROM {customer} WHERE c_nationkey % 4 <> 3"


@query("region_stages", f"""{JUDGED}, {_score_sql("(SELECT * FROM judged WHERE disposition = 'final')")}, best AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY preliminary_score DESC, fetched_at, hit_no) AS rank FROM scored),
facts AS (SELECT {_REGIONS.replace(', 0 AS power_screened_count', '')} FROM judged WHERE region_name IS NOT NULL GROUP BY region_name), regions AS (SELECT 'Region ' || cast(n_nationkey AS varchar) AS region_name FROM nation),
asked AS (SELECT region_name, count(*) AS n FROM ({_ASKED_REGIONS.format(customer='customer')}) GROUP BY region_name), screened AS (SELECT region_name, count(*) AS n FROM best WHERE rank <= 20 GROUP BY region_name)
SELECT r.region_name, coalesce(a.n, 0) AS executed_query_count, coalesce(raw_result_count, 0) AS raw_result_count, coalesce(specific_listing_count, 0) AS specific_listing_count, coalesce(final_candidate_count, 0) AS final_candidate_count,
  coalesce(s.n, 0) AS power_screened_count, CASE WHEN a.n > 0 THEN 'success' ELSE 'pending' END AS status FROM regions r LEFT JOIN asked a USING (region_name) LEFT JOIN facts f USING (region_name) LEFT JOIN screened s USING (region_name)""")
def _(spark, sf):
    regions = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("Region "), "n_nationkey").alias("region_name"))
    asked = spark.sql(_ASKED_REGIONS, customer=spark.read.parquet(f"{sf}/customer.parquet"))
    hit_rows = judged(spark, sf)
    scored = sites.score_site(hit_rows.filter(F.col("disposition") == "final"))
    # the feature: a search screens its twenty best
    screened = ranked_per_group(scored, ["job_id"], [F.desc("preliminary_score"), *[F.asc(o) for o in ORDER]], 20)
    return funnel.region_stages(regions, asked, hit_rows, screened)


@query("score_site", f"{CLASSED}, {_score_sql('classed')} SELECT hit_no, preliminary_score, {_GRADE} AS preliminary_grade, {joined_sql(_REASONS)} AS score_reasons FROM scored")
def _(spark, sf):
    return sites.score_site(normal(spark, sf)).select("hit_no", "preliminary_score", "preliminary_grade", joined("score_reasons"))


@query("rank_generic", f"{CLASSED}, {_score_sql('classed')} SELECT hit_no, preliminary_score, row_number() OVER (ORDER BY preliminary_score DESC, fetched_at, hit_no) AS position FROM scored")
def _(spark, sf):
    scored = sites.score_site(normal(spark, sf)).select("preliminary_score", *ORDER)
    return retail.rank_by_score(scored, "preliminary_score", *ORDER, position="position").select("hit_no", "preliminary_score", "position")


@query("site_view", f"{NORM} SELECT hit_no, city FROM norm WHERE contains(lower(coalesce(state, '')), 'tex') AND contains(lower(coalesce(city, '')), 'abilene') AND contains(lower(coalesce(property_type, '')), 'house') AND (land_acres IS NULL OR land_acres >= 20) AND (asking_price_usd IS NULL OR asking_price_usd <= 6000000)")
def _(spark, sf):
    return lifecycle.site_view(normal(spark, sf), "tex", "abilene", "house", 20, 6000000).select("hit_no", "city")


@query("listing_priority", f"""{NORM}, p AS (SELECT *, {num(rx('text', rules.FULL_PRICE_PATTERN))} AS price FROM norm)
SELECT hit_no, row_number() OVER (ORDER BY CASE WHEN price > 10000000 THEN 1 ELSE 0 END, coalesce(price, 10000000), coalesce(-land_acres, 0), hit_no) AS position FROM p""")
def _(spark, sf):
    links = hits(spark, sf).withColumns({"title": F.col("original_title"), "summary": F.col("original_description")})
    return sites.listing_priority(links.select("hit_no", "title", "summary"), "hit_no", position="position").select("hit_no", "position")


_TOP = f"""{JUDGED}, {_score_sql("(SELECT * FROM judged WHERE disposition = 'final')")}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY preliminary_score DESC, fetched_at, hit_no) AS rank FROM scored)"""


_NO_PLACE = "address_line_1 IS NULL AND city IS NULL AND state IS NULL AND zip_code IS NULL"
_FULL_PLACE = "address_line_1 IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL AND zip_code IS NOT NULL"


@query("site_search", f"""{_TOP} SELECT job_id, rank, hit_no, preliminary_score,
  CASE WHEN {_NO_PLACE} THEN 'address_needs_verification' WHEN {_FULL_PLACE} THEN 'geocoding_failed' ELSE 'partial_address' END AS geocoding_status FROM ranked""")
def _(spark, sf):
    found = scans.site_search(hits(spark, sf), criteria(spark, sf), record(spark, sf, "asset"), ORDER)
    return found.select("job_id", "rank", "hit_no", "preliminary_score", "geocoding_status")


# the numbered county roads, as a geocoder's reference table has them; one road in five is missing
_ROADS = """SELECT DISTINCT concat(cast(100 + o_custkey % 900 AS varchar(20)), ' County Road ', cast(o_custkey % 90 + 1 AS varchar(20)), ', Abilene, Texas, 79601') AS address,
  25.0 + cast(o_custkey % 100 * 6007 % 24000 AS double) / 1000 + cast(o_custkey % 900 % 7 AS double) / 20 AS ref_lat, -70.0 - cast(o_custkey % 100 * 31337 % 50000 AS double) / 1000 - cast(o_custkey % 900 % 9 AS double) / 20 AS ref_lon FROM {orders} WHERE o_custkey % 5 <> 0"""
_CENTRES = "SELECT n_nationkey AS job_id, cast(30 + n_nationkey % 10 AS double) AS lat, cast(-90 - n_nationkey AS double) AS lon, cast(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 300 + 40 * n_nationkey END AS double) AS radius_miles FROM {nation} WHERE n_nationkey % 7 <> 6"
_GRID = "SELECT * REPLACE (CASE asset_type WHEN 'tower' THEN 'transmission_line' ELSE asset_type END AS asset_type), NOT (asset_type = 'tower' AND asset_id % 2 = 0) AS ring_limited FROM asset"
_REACH = [10.0, 20.0, 35.0, 50.0]
_RINGS = "CASE " + " ".join(f"WHEN distance_miles <= {r} THEN {r}" for r in _REACH) + " END"
_NEAR = f"round({haversine_sql('p.lat', 'p.lon', 'a.lat', 'a.lon')}, 3)"
_AWAY = f"round({haversine_sql('c.lat', 'c.lon', 'l.lat', 'l.lon')}, 3)"


@query("site_search_screened", f"""{_TOP}, roads AS ({_ROADS.format(orders='orders')}), centre AS ({_CENTRES.format(nation='nation')}), {cte('asset')}, grid AS ({_GRID}),
located AS (SELECT r.job_id, r.rank, r.hit_no, g.ref_lat AS lat, g.ref_lon AS lon, CASE WHEN g.ref_lat IS NOT NULL THEN 'geocoded_address' WHEN {_NO_PLACE} THEN 'address_needs_verification' WHEN {_FULL_PLACE} THEN 'geocoding_failed' ELSE 'partial_address' END AS geocoding_status
  FROM ranked r LEFT JOIN roads g ON {_FULL_PLACE} AND lower(address_line_1 || ', ' || city || ', ' || state || ', ' || zip_code) = lower(g.address)),
points AS (SELECT DISTINCT lat, lon FROM located WHERE lat IS NOT NULL), pairs AS (SELECT p.lat, p.lon, a.asset_id, a.asset_type, a.voltage_kv, a.ring_limited, {_NEAR} AS distance_miles FROM points p JOIN grid a ON {_NEAR} <= {max(_REACH)}),
ringed AS (SELECT *, min(CASE WHEN ring_limited THEN {_RINGS} END) OVER (PARTITION BY lat, lon) AS ring FROM pairs), kept AS (SELECT * FROM ringed WHERE NOT ring_limited OR distance_miles <= ring),
figures AS (SELECT lat, lon, min(distance_miles) FILTER (asset_type = 'substation') AS nearest_substation_miles, min(distance_miles) FILTER (asset_type = 'transmission_line') AS nearest_line_miles, max(nullif(voltage_kv, 0)) AS known_voltage_kv, count(*) AS asset_count,
  count(*) FILTER (distance_miles <= 20) AS within_20_mile FROM kept GROUP BY lat, lon)
SELECT l.job_id, l.rank, l.hit_no, l.geocoding_status, l.lat, l.lon, nearest_substation_miles, nearest_line_miles, known_voltage_kv, coalesce(asset_count, 0) AS asset_count, coalesce(within_20_mile, 0) AS within_20_mile, {_AWAY} AS distance_to_search_anchor_miles,
  CASE WHEN c.job_id IS NOT NULL AND l.lat IS NULL THEN 'needs_verification: distance_to_search_anchor unknown' END AS anchor_flag FROM located l LEFT JOIN figures f ON f.lat = l.lat AND f.lon = l.lon LEFT JOIN centre c ON c.job_id = l.job_id
WHERE NOT coalesce(nullif(c.radius_miles, 0) < {_AWAY}, false)""")
def _(spark, sf):
    tower = F.col("asset_type") == "tower"
    grid = record(spark, sf, "asset").withColumn("ring_limited", ~(tower & (F.col("asset_id") % 2 == 0))).withColumn(
        "asset_type", F.when(tower, "transmission_line").otherwise(F.col("asset_type")))
    roads = spark.sql(_ROADS, orders=spark.read.parquet(f"{sf}/orders.parquet"))
    centres = spark.sql(_CENTRES, nation=spark.read.parquet(f"{sf}/nation.parquet"))
    found = scans.site_search(hits(spark, sf), criteria(spark, sf), grid, ORDER, reference=roads, anchors=centres, radii=_REACH)
    return found.select("job_id", "rank", "hit_no", "geocoding_status", "lat", "lon", "nearest_substation_miles", "nearest_line_miles", "known_voltage_kv", "asset_count",
                        "within_20_mile", "distance_to_search_anchor_miles", "anchor_flag")
