"""Queries over requirement texts and search grids."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog.records import cte, load, record
from dealsift.catalog.registry import distinct_list, flags, has, joined, joined_sql, label_list, num, q, query, rx
from dealsift.operators import requests as R

_REQ = f"WITH {cte('request')}, t AS (SELECT *, lower(request_text) AS low FROM request)"


def _states(label: int) -> str:
    """List of the names (1) or codes (0) of the states named in the text, in table order."""
    stripped = "upper(regexp_replace(trim(request_text), '^[,.;:，。；：]+|[,.;:，。；：]+$', '', 'g'))"
    pairs = []
    for code, name, aliases in rules.US_STATES:
        word = f"regexp_matches(request_text, '(^|[^\\p{{L}}\\p{{N}}_]){code}($|[^\\p{{L}}\\p{{N}}_])')"
        pairs.append((f"{word} OR {stripped} = '{code}' OR {has('low', [a.lower() for a in [name, *aliases]])}", (code, name)[label]))
    return flags(pairs)


_NAMED = f"named AS (SELECT *, {_states(1)} AS states, {_states(0)} AS codes FROM t)"


def asked(spark, sf) -> DataFrame:
    return record(spark, sf, "request")


@query("alias_match", f"{_REQ}, {_NAMED} SELECT request_id, unnest(codes) AS state_code, unnest(states) AS state_name FROM named")
def _(spark, sf):
    return R.alias_match(asked(spark, sf), "request_text").select("request_id", "state_code", "state_name")


_SUPPLIER = f"WITH {cte('supplier_request')}, t AS (SELECT *, lower(request_text) AS low FROM supplier_request)"


@query("keyword_tagging", f"""{_SUPPLIER} SELECT request_id, {joined_sql(label_list('low', [(t, [x.lower() for x in w]) for t, w in rules.SUPPLIER_TYPE_TOKENS]))} AS supplier_types, {joined_sql(label_list('low', rules.REQUEST_EQUIPMENT_TOKENS))} AS equipment_types,
  {joined_sql(label_list('low', [('R2', ['r2']), ('e-Stewards', ['e-stewards']), ('NAID AAA', ['naid'])]))} AS certifications, {has('low', ['bulk', '批量', 'wholesale'])} AS bulk_sales FROM t""")
def _(spark, sf):
    texts = R.extract_supplier_criteria(record(spark, sf, "supplier_request"))
    tagged = R.keyword_tagging(texts.drop("supplier_types"), "request_text", rules.SUPPLIER_TYPE_TOKENS, "supplier_types")
    return tagged.select("request_id", joined("supplier_types"), joined("equipment_types"), joined("certifications"), "bulk_sales")


_FIG, _COM = r"(\d+(?:\.\d+)?)", r"(\d+(?:,\d{3})*(?:\.\d+)?)"


def _n(pattern: str, flag: str = "i") -> str:
    return num(rx("request_text", pattern, 1, flag))


_PAIR = r"(-?\d{1,3}(?:\.\d+)?)\s*[,，]\s*(-?\d{1,3}(?:\.\d+)?)"
_A, _B = num(rx("request_text", _PAIR, 1)), num(rx("request_text", _PAIR, 2))
_SWAP = f"({_B} BETWEEN 24 AND 50 AND {_A} BETWEEN -125 AND -66)"
_ZIPLIST = distinct_list(f"regexp_extract_all(request_text, {q(rules.ZIP_PATTERN)})")
_TYPES = label_list("low", rules.PROPERTY_TYPE_TOKENS)
_DEALS = label_list("low", [("for lease", ["租", "lease"]), ("for sale", ["买", "售", "sale"])])
_USE = "CASE " + " ".join(f"WHEN {has('low', t)} THEN '{u}'" for u, t in rules.PROJECT_USE_TOKENS) + " END"
_CRITERIA = f"""SELECT request_id, array_to_string(states, '|') AS states, {joined_sql(_ZIPLIST)} AS zip_codes,
  round(coalesce({_n(_FIG + r'\s*(?:英里|mile|miles|mi)')}, round({_n(_FIG + r'\s*(?:公里|km)')} * 0.6214, 2)), 4) AS radius_miles,
  coalesce({_n(_FIG + r'\s*(?:\+|以上|至少|英亩|acres?)')}, round({_n(_FIG + r'\s*亩')} * 0.1647, 2)) AS min_land_acres,
  coalesce({_n(_COM + r'\s*(?:sqft|square feet|平方英尺)')}, round({_n(_COM + r'\s*(?:平方米|平米)')} * 10.7639, 2)) AS min_building_sqft,
  coalesce({_n(_FIG + r'\s*(?:million\b|m\b)\s*(?:usd|dollars?)?')} * 1000000, {_n(_FIG + r'\s*万\s*美元')} * 10000, {_n(r'\$?\s*(\d+(?:,\d{3})+(?:\.\d+)?)')}) AS max_price_usd,
  {_n(_FIG + r'\s*(?:mw|兆瓦)')} AS target_load_mw, {_n(_FIG + r'\s*(?:kv|kV|千伏)', 'c')} AS preferred_transmission_voltage_kv,
  array_to_string(CASE WHEN len({_TYPES}) > 0 THEN {_TYPES} ELSE ['industrial property', 'industrial land'] END, '|') AS property_types,
  array_to_string(CASE WHEN len({_DEALS}) > 0 THEN {_DEALS} ELSE ['for sale'] END, '|') AS transaction_types, {_USE} AS project_use,
  CASE WHEN {_A} IS NOT NULL THEN 'coordinates' WHEN len({_ZIPLIST}) = 1 THEN 'zip_code' END AS anchor_type, CASE WHEN {_SWAP} THEN {_B} ELSE {_A} END AS anchor_lat,
  CASE WHEN {_A} IS NULL AND len({_ZIPLIST}) = 1 THEN {_ZIPLIST}[1][1:5] END AS anchor_zip FROM named"""


@query("extract_criteria", f"{_REQ}, {_NAMED} {_CRITERIA}")
def _(spark, sf):
    found = R.extract_criteria(asked(spark, sf))
    return found.select(
        "request_id", joined("states"), joined("zip_codes"), "radius_miles", "min_land_acres", "min_building_sqft", "max_price_usd", "target_load_mw",
        "preferred_transmission_voltage_kv", joined("property_types"), joined("transaction_types"), "project_use", "anchor_type", "anchor_lat", "anchor_zip")


_TERMS = "CASE p {} ELSE [p] END".format(" ".join(f"WHEN {q(n)} THEN [{', '.join(q(x) for x in t)}]" for n, t in rules.PROPERTY_TERMS))
_ASKED_TYPES = "CASE o_orderkey % 4 WHEN 0 THEN ['warehouse', 'industrial land'] WHEN 1 THEN ['powered land', 'data hall'] WHEN 2 THEN ['former manufacturing facility', 'manufacturing facility', 'warehouse'] ELSE [] END"
_EXPANDED = f"flatten(list_transform({_ASKED_TYPES}, lambda p: {_TERMS}))"


@query("term_expansion", f"""WITH e AS (SELECT o_orderkey AS request_id, {_EXPANDED} AS terms FROM orders), d AS (SELECT request_id, CASE WHEN len(terms) > 0 THEN {distinct_list('terms')} ELSE ['industrial property', 'industrial land'] END AS terms FROM e)
SELECT request_id, i - 1 AS term_pos, terms[i] AS term FROM d, unnest(range(1, len(terms) + 1)) AS u(i)""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4

    def words(*values: str):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    types = F.when(k == 0, words("warehouse", "industrial land")).when(k == 1, words("powered land", "data hall")).when(
        k == 2, words("former manufacturing facility", "manufacturing facility", "warehouse")).otherwise(words())
    asked_types = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), types.alias("property_types"))
    return R.term_expansion(asked_types)


_PROFILE = "profile(code, region_ord, region_name, region_type, cities) AS (VALUES " + ", ".join(
    f"('{r[0]}', {i}, {q(r[2])}, '{r[3]}', {q('|'.join(r[4]))})" for i, r in enumerate(rules.SITE_REGIONS)) + ")"


@query("profile_lookup", f"WITH {_PROFILE}, c AS (SELECT o_orderkey AS request_id, CASE o_custkey % 3 WHEN 0 THEN 'tx' WHEN 1 THEN 'TX' ELSE 'GA' END AS state_code FROM orders) SELECT request_id, region_ord, region_name, cities FROM c LEFT JOIN profile ON upper(state_code) = code")
def _(spark, sf):
    k = F.col("o_custkey") % 3
    wanted = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("request_id"), F.when(k == 0, "tx").when(k == 1, "TX").otherwise("GA").alias("state_code"))
    return R.profile_lookup(wanted).select("request_id", "region_ord", "region_name", F.array_join("cities", "|").alias("cities"))


# ---------------------------------------------------------------- grids

_CELLS = "cells(category, source_group, source_ord, stem, cell) AS (VALUES " + ", ".join(
    f"('{c}', {q(s)}, {si}, {q(f'site:{d} {t}' if d else f'{t} auction surplus liquidation')}, {n})"
    for n, (c, s, si, d, t) in enumerate((c, s, si, d, t) for c, terms in rules.CATEGORY_SEARCH_TERMS.items()
                                         for si, (s, d) in enumerate(rules.HARDWARE_SOURCES) for t in terms[:2])) + ")"
_SUFFIX = "suffixes AS (SELECT c_custkey AS request_id, i, s[i] AS suffix FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['Texas', 'Nowhere'] WHEN 1 THEN ['Ohio'] ELSE [''] END AS s FROM customer), unnest(range(1, len(s) + 1)) AS u(i))"
_GRID = f"WITH {_CELLS}, {_SUFFIX}, grid AS (SELECT request_id, category, source_group, source_ord, trim(stem || ' ' || suffix) AS query, row_number() OVER (PARTITION BY request_id ORDER BY cell, i) - 1 AS pos FROM suffixes CROSS JOIN cells)"


def _grid(spark, sf) -> DataFrame:
    """Hardware requests."""
    k = F.col("c_custkey") % 3
    names = F.when(k == 0, F.array(F.lit("tx"), F.lit(" Nowhere "))).when(k == 1, F.array(F.lit("OH"))).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), names.alias("state_names"))


@query("query_grid", f"{_GRID} SELECT request_id, pos, category, source_group, query FROM grid")
def _(spark, sf):
    return R.hardware_grid(_grid(spark, sf), ["request_id"]).select("request_id", "pos", "category", "source_group", "query")


@query("round_robin_cap", f"""{_GRID}, turns AS (SELECT *, row_number() OVER (PARTITION BY request_id, category, source_group ORDER BY pos) AS turn FROM grid),
picked AS (SELECT *, row_number() OVER (PARTITION BY request_id, category ORDER BY turn, source_ord) AS pick FROM turns) SELECT request_id, category, query, pick FROM picked WHERE pick <= 8""")
def _(spark, sf):
    return R.round_robin_cap(_grid(spark, sf), R.hardware_queries(), ["request_id"], limit=8).select("request_id", "category", "query", "pick")


def _found(spark, sf) -> DataFrame:
    return R.extract_criteria(asked(spark, sf))


# SQL for the grids: built from criteria the comparison derives on its own
_LON = f"CASE WHEN {_SWAP} THEN {_A} ELSE {_B} END"
_COUNTIES = "list_filter(list_transform(regexp_extract_all(request_text, '([A-Za-z][A-Za-z\\s.''-]+)\\s+County', 1), lambda k: trim(k)), lambda k: k <> '')"


def _plain(column: str) -> str:
    return f"CASE WHEN {column} = floor({column}) THEN cast(cast({column} AS bigint) AS varchar) ELSE cast({column} AS varchar) END"


_CRIT = f"""crit AS ({_CRITERIA.replace(' FROM named', f', {_LON} AS anchor_lon, {distinct_list(_COUNTIES)} AS counties FROM named')}), c AS (SELECT request_id, string_split(states, '|') AS states, states = '' AS no_state, string_split(property_types, '|') AS types,
  string_split(transaction_types, '|')[1] AS deal, anchor_type, anchor_lat, anchor_lon, anchor_zip, counties, CASE WHEN zip_codes = '' THEN [] ELSE string_split(zip_codes, '|') END AS zips,
  CASE WHEN min_land_acres <> 0 THEN ' ' || {_plain('min_land_acres')} || '+ acres' ELSE '' END || CASE WHEN max_price_usd <> 0 THEN ' under $' || format('{{:,.0f}}', max_price_usd) ELSE '' END
    || CASE WHEN anchor_type IS NOT NULL AND radius_miles <> 0 THEN ' within ' || {_plain('radius_miles')} || ' miles' ELSE '' END AS tail FROM crit),
terms AS (SELECT *, list_concat(types, flatten(list_transform(types, lambda p: {_TERMS}))) AS raw_terms FROM c)"""
_BASE = f"{_REQ}, {_NAMED}, {_CRIT}"
_PLACE = "struct_pack(state := {}, phrase := {})"
_NOWHERE = "cast(NULL AS varchar)"
_STD = f"""{_BASE}, tt AS (SELECT *, {distinct_list('raw_terms')} AS all_terms FROM terms),
pl AS (SELECT *, list_concat(CASE anchor_type WHEN 'zip_code' THEN [{_PLACE.format(_NOWHERE, "'near ZIP ' || anchor_zip")}] WHEN 'coordinates' THEN [{_PLACE.format(_NOWHERE, "'near ' || printf('%.6f', anchor_lat) || ', ' || printf('%.6f', anchor_lon)")}] ELSE [] END,
  CASE WHEN no_state THEN [] ELSE flatten(list_transform(states, lambda s: list_concat([{_PLACE.format('s', 's')}], list_transform(counties, lambda k: {_PLACE.format('s', "CASE WHEN ends_with(lower(k), ' county') THEN k ELSE k || ' County' END || ' ' || s")})))) END) AS named_places FROM tt),
pp AS (SELECT *, CASE WHEN len(named_places) > 0 THEN named_places WHEN len(zips) > 0 THEN list_transform(zips, lambda z: {_PLACE.format(_NOWHERE, 'z')}) ELSE [{_PLACE.format(_NOWHERE, "'United States'")}] END AS places FROM pl),
at_place AS (SELECT request_id, s.i AS si, places[s.i].state AS state, places[s.i].phrase AS phrase, coalesce(places[s.i].state, places[s.i].phrase) AS region, all_terms, deal, tail FROM pp, unnest(range(1, len(places) + 1)) AS s(i)),
raw AS (SELECT request_id, si, t.j AS tj, state, trim(all_terms[t.j] || ' ' || deal || ' ' || phrase || tail) AS query, 'property_market' AS source_group FROM at_place, unnest(range(1, len(all_terms) + 1)) AS t(j)
  UNION ALL SELECT request_id, si, 1000 + g.k, state, g.lead || CASE WHEN g.k > 3 THEN region ELSE phrase END, g.grp FROM at_place, (VALUES (1, 'economic development available sites ', 'economic_development'), (2, 'industrial park available buildings ', 'industrial_park'),
    (3, 'commercial real estate industrial broker ', 'local_brokerage'), (4, 'powered land for data center ', 'utility'), (5, 'shovel-ready industrial site ', 'economic_development')) AS g(k, lead, grp)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY si, tj) AS n FROM raw), uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(query) ORDER BY n) AS d FROM numbered) WHERE d = 1),
grid AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n) - 1 AS pos FROM uniq)"""


def _standard(spark, sf) -> DataFrame:
    """All requests; the radius they name is that around their anchor."""
    found = _found(spark, sf)
    return found.withColumn("anchor_radius_miles", F.when(F.col("anchor_type").isNotNull(), F.col("radius_miles")))


@query("site_query_grid", f"{_STD} SELECT request_id, pos, query, source_group, state AS query_state FROM grid")
def _(spark, sf):
    return R.site_grid(_standard(spark, sf), ["request_id"]).select("request_id", "pos", "query", "source_group", "query_state")


@query("priority_pick", f"""{_STD}, first_state AS (SELECT *, max(state) OVER (PARTITION BY request_id) AS stated, min(pos) OVER (PARTITION BY request_id, state) AS so, min(pos) FILTER (source_group = 'property_market') OVER (PARTITION BY request_id, state) AS m1, min(pos) OVER (PARTITION BY request_id, state, source_group) AS g1 FROM grid),
second AS (SELECT *, min(pos) FILTER (source_group = 'property_market' AND contains(lower(query), 'industrial land') AND pos <> m1) OVER (PARTITION BY request_id, state) AS m2 FROM first_state),
tiers AS (SELECT *, CASE WHEN state IS NULL AND stated IS NOT NULL THEN NULL WHEN pos = m1 THEN 1 WHEN pos = m2 THEN 2 WHEN source_group = 'economic_development' AND pos = g1 THEN 3 WHEN source_group = 'industrial_park' AND pos = g1 THEN 4 WHEN source_group = 'utility' AND pos = g1 THEN 5 WHEN source_group = 'local_brokerage' AND pos = g1 THEN 6 END AS tier FROM second),
picked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN tier IS NULL THEN 1 ELSE 0 END, CASE WHEN tier IS NOT NULL THEN so END, tier, pos) AS pick FROM tiers) SELECT request_id, query, pick FROM picked""")
def _(spark, sf):
    asked_for = R.with_site_queries(_standard(spark, sf))
    return R.priority_pick(asked_for, F.col("_queries"), ["request_id"]).select("request_id", "query", "pick")


_REGION_PHRASES = "phrases(ro, po, region_name, phrase) AS (VALUES " + ", ".join(
    f"({i}, {j}, {q(r[2])}, {q(p)})" for i, r in enumerate(rules.SITE_REGIONS) for j, p in enumerate(R._region_phrases(r))) + ")"
_WIDE = "wide(k, grp, query) AS (VALUES " + ", ".join(f"({i}, '{g}', {q(t)})" for i, (g, t) in enumerate(rules.SITE_STATEWIDE_QUERIES)) + ")"
_FALL = "[" + ", ".join(q(t) for t in rules.STATE_SEARCH_FALLBACK_TERMS) + "]"
_STATE = f"""{_BASE}, {_REGION_PHRASES}, {_WIDE}, tt AS (SELECT *, list_concat(raw_terms, {_FALL}) AS more FROM terms WHERE anchor_type IS NULL AND states[1] = 'Texas'), t4 AS (SELECT *, ({distinct_list('more')})[1:4] AS terms4 FROM tt),
raw AS (SELECT request_id, ro, po, t.j AS tj, region_name, trim(terms4[t.j] || ' ' || deal || ' ' || phrase || tail) AS query, 'state_region_property_market' AS source_group FROM t4 CROSS JOIN phrases, unnest(range(1, len(terms4) + 1)) AS t(j)
  UNION ALL SELECT request_id, ro, po, 100, region_name, 'industrial acreage ' || phrase, 'state_region_property_market' FROM t4 CROSS JOIN phrases
  UNION ALL SELECT request_id, ro, po, 101, region_name, 'commercial real estate industrial broker ' || phrase, 'state_region_local_brokerage' FROM t4 CROSS JOIN phrases
  UNION ALL SELECT request_id, 999, k, 0, 'Statewide', w.query, w.grp FROM t4 CROSS JOIN wide w),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ro, po, tj) AS n FROM raw), uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(query) ORDER BY n) AS d FROM numbered) WHERE d = 1),
grid AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n) - 1 AS pos FROM uniq)"""


def _state(spark, sf) -> DataFrame:
    return R.with_state_queries(_found(spark, sf))


@query("state_query_grid", f"{_STATE} SELECT request_id, pos, query, source_group, region_name FROM grid")
def _(spark, sf):
    return R.state_grid(_found(spark, sf), ["request_id"]).select("request_id", "pos", "query", "source_group", "region_name")


@query("top_n_per_group", f"""{_STATE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, region_name ORDER BY pos) AS rk FROM grid), b AS (SELECT *, row_number() OVER (PARTITION BY request_id, region_name, rk > 2 AND source_group = 'state_region_local_brokerage' ORDER BY pos) AS br FROM ranked),
tiers AS (SELECT *, CASE WHEN region_name <> 'Statewide' AND rk <= 2 THEN 1 WHEN region_name = 'Statewide' THEN 2 WHEN source_group = 'state_region_local_brokerage' AND br = 1 THEN 3 END AS tier FROM b),
picked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, CASE WHEN region_name = 'Statewide' THEN CASE WHEN source_group = 'state_utility' THEN 1 ELSE 0 END ELSE ro END, pos) AS pick FROM tiers WHERE tier IS NOT NULL)
SELECT request_id, query, pick FROM picked WHERE pick <= 36""")
def _(spark, sf):
    return R.top_queries_per_region(_state(spark, sf), F.col("_queries"), ["request_id"], limit=36).select("request_id", "query", "pick")


_SUP_REGIONS = "regions(ro, po, region_name, phrase) AS (VALUES " + ", ".join(
    f"({i}, {j}, {q(r[2])}, {q(p)})" for i, r in enumerate(rules.SUPPLIER_REGIONS) for j, p in enumerate(r[4][:2])) + ")"
_SUP_WIDE = "wide(k, query) AS (VALUES " + ", ".join(f"({i}, {q(t)})" for i, t in enumerate(rules.SUPPLIER_STATEWIDE_QUERIES)) + ")"
_DEFAULTS = "[" + ", ".join(q(t) for t in rules.DEFAULT_SUPPLIER_TYPES) + "]"
_SUPPLIER_GRID = f"""{_SUPPLIER}, {_NAMED}, {_SUP_REGIONS}, {_SUP_WIDE}, s0 AS (SELECT request_id, CASE WHEN len(states) > 0 THEN states ELSE ['United States'] END AS states, coalesce(codes[1], '') AS code, list_concat({label_list('low', [(t, [x.lower() for x in w]) for t, w in rules.SUPPLIER_TYPE_TOKENS])}, {_DEFAULTS}) AS raw_terms FROM named),
s1 AS (SELECT *, {distinct_list('raw_terms')} AS terms FROM s0),
raw AS (SELECT request_id, ro, po, u.j AS tj, region_name, terms[u.j] || ' ' || phrase AS query FROM s1 CROSS JOIN regions, unnest(range(1, 6)) AS u(j) WHERE code = 'TX' UNION ALL SELECT request_id, 999, k, 0, 'Statewide', wide.query FROM s1 CROSS JOIN wide WHERE code = 'TX'
  UNION ALL SELECT request_id, v.i, 0, u.j, NULL, terms[u.j] || ' ' || states[v.i] FROM s1, unnest(range(1, len(states) + 1)) AS v(i), unnest(range(1, least(8, len(terms)) + 1)) AS u(j) WHERE code <> 'TX'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ro, po, tj) AS n FROM raw), uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(query) ORDER BY n) AS d FROM numbered) WHERE d = 1)"""


@query("supplier_query_grid", f"{_SUPPLIER_GRID} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY n) - 1 AS pos, query, region_name FROM uniq")
def _(spark, sf):
    wanted = R.extract_supplier_criteria(record(spark, sf, "supplier_request"))
    return R.supplier_grid(wanted, ["request_id"]).select("request_id", "pos", "query", "region_name")
