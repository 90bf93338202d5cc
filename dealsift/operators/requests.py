"""Requirement texts: criteria found in them, query grids built from them and the choice of queries.

Rule tables are literal arrays inside the expressions, so tagging and grids need no join.
"""

from pyspark.sql import Column, DataFrame, functions as F

from dealsift import rules
from dealsift.functions import address, geo, labels
from dealsift.functions.amount import number
from dealsift.functions.fence import keep_rows
from dealsift.functions.text import capture, contains_any, once, token_labels
from dealsift.schemas import with_missing

_EDGE = r"[\p{L}\p{N}_]"


def state_matches(text: Column) -> Column:
    """Array of (code, name) of the states a text names, in table order.

    Codes count as upper-case words or as the whole text; names and Chinese aliases anywhere.
    """
    table = F.array(*[
        F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"),
                 F.array(*[F.lit(a.lower()) for a in [name, *aliases]]).alias("aliases"))
        for code, name, aliases in rules.US_STATES])
    codes = "|".join(code for code, _, _ in rules.US_STATES)
    said = F.struct(
        F.regexp_extract_all(text, F.lit(rf"(?<!{_EDGE})(?:{codes})(?!{_EDGE})"), F.lit(0)).alias("words"),
        F.upper(F.regexp_replace(F.trim(text), r"^[,.;:，。；：]+|[,.;:，。；：]+$", "")).alias("whole"),
        F.lower(text).alias("lowered"))
    found = once(said, lambda t: F.filter(table, lambda s: F.array_contains(t["words"], s["code"]) | (
        t["whole"] == s["code"]) | F.exists(s["aliases"], lambda a: t["lowered"].contains(a))))
    return F.transform(found, lambda s: F.struct(s["code"].alias("code"), s["name"].alias("name")))


def alias_match(texts: DataFrame, text: str) -> DataFrame:
    """One row per text and state it names."""
    return texts.withColumn("_state", F.explode(state_matches(F.col(text)))).select(
        *texts.columns, F.col("_state.code").alias("state_code"), F.col("_state.name").alias("state_name"))


def keyword_tagging(texts: DataFrame, text: str, dictionary: list[tuple[str, list[str]]], tags: str = "tags") -> DataFrame:
    """Add the distinct tags one of whose tokens occurs in the text, in dictionary order."""
    lowered = F.lower(text)
    return texts.withColumn(tags, token_labels(lowered, [(tag, [t.lower() for t in tokens]) for tag, tokens in dictionary]))


def _array_or(found: Column, default: list[str]) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(d) for d in default]))


def _given(df: DataFrame, name: str, found: Column, kind: str) -> Column:
    """A filled structured value wins over the text."""
    if name not in df.columns:
        return found
    if kind == "array":
        return F.array_distinct(F.concat(F.coalesce(F.col(name), F.array().cast("array<string>")), found))
    missing = F.nullif(F.col(name), F.lit("" if kind == "string" else 0.0))
    return F.coalesce(missing, found)


def _counties(text: Column) -> Column:
    english = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z\s.'-]+)\s+County"), F.lit(1))
    chinese = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}A-Za-z\s.'-]+)县"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(F.concat(english, chinese), lambda c: F.trim(c))), lambda c: c != "")


def _miles(text: Column, lead: str = "") -> Column:
    miles = number(capture(text, lead + r"(\d+(?:\.\d+)?)\s*(?:英里|mile|miles|mi)"))
    km = number(capture(text, lead + r"(\d+(?:\.\d+)?)\s*(?:公里|km)"))
    return F.coalesce(miles, F.round(km * 0.6214, 2))


def extract_criteria(requests: DataFrame, text: str = "request_text") -> DataFrame:
    """Search criteria of free-text site requirements (English or Chinese)."""
    source, lowered = F.col(text), F.lower(text)
    figure = r"(\d+(?:\.\d+)?)"
    commas = r"(\d+(?:,\d{3})*(?:\.\d+)?)"
    states = state_matches(source)
    zips = F.array_distinct(F.regexp_extract_all(source, F.lit(rules.ZIP_PATTERN), F.lit(0)))
    acres = F.coalesce(
        number(capture(source, figure + r"\s*(?:\+|以上|至少|英亩|acres?)")),
        F.round(number(capture(source, figure + r"\s*亩")) * 0.1647, 2))
    sqft = F.coalesce(
        number(capture(source, commas + r"\s*(?:sqft|square feet|平方英尺)")),
        F.round(number(capture(source, commas + r"\s*(?:平方米|平米)")) * 10.7639, 2))
    price = F.coalesce(
        number(capture(source, figure + r"\s*(?:million\b|m\b)\s*(?:usd|dollars?)?")) * 1000000.0,
        number(capture(source, figure + r"\s*万\s*美元")) * 10000.0,
        number(capture(source, r"\$?\s*(\d+(?:,\d{3})+(?:\.\d+)?)")))
    substation = contains_any(lowered, ["变电站", "substation"])
    near_substation = F.coalesce(
        number(capture(source, figure + r"\s*(?:英里|mile|miles)")),
        F.round(number(capture(source, figure + r"\s*(?:公里|km)")) * 0.6214, 2))
    deals = F.array_compact(F.array(
        F.when(contains_any(lowered, ["租", "lease"]), F.lit("for lease")),
        F.when(contains_any(lowered, ["买", "售", "sale"]), F.lit("for sale"))))
    uses = F.coalesce(*[F.when(contains_any(lowered, tokens), F.lit(use)) for use, tokens in rules.PROJECT_USE_TOKENS])
    df = requests.withColumn("_named", states).withColumns({
        "states": _given(requests, "states", F.col("_named.name"), "array"),
        "state_codes": _given(requests, "state_codes", F.col("_named.code"), "array"),
        "zip_codes": _given(requests, "zip_codes", zips, "array"),
        "counties": _given(requests, "counties", _counties(source), "array"),
        "radius_miles": _given(requests, "radius_miles", _miles(source), "number"),
        "min_land_acres": _given(requests, "min_land_acres", acres, "number"),
        "min_building_sqft": _given(requests, "min_building_sqft", sqft, "number"),
        "max_price_usd": _given(requests, "max_price_usd", price, "number"),
        "target_load_mw": _given(requests, "target_load_mw", number(capture(source, figure + r"\s*(?:mw|兆瓦)")), "number"),
        "preferred_substation_distance_miles": F.when(substation, near_substation),
        "preferred_transmission_voltage_kv": number(capture(source, figure + r"\s*(?:kv|kV|千伏)", 1, ignore_case=False)),
        "property_types": _array_or(
            _given(requests, "property_types", token_labels(lowered, rules.PROPERTY_TYPE_TOKENS), "array"),
            rules.DEFAULT_PROPERTY_TYPES),
        "transaction_types": _array_or(_given(requests, "transaction_types", deals, "array"), ["for sale"]),
        "project_use": _given(requests, "project_use", uses, "string"),
    })
    pair = r"(-?\d{1,3}(?:\.\d+)?)\s*[,，]\s*(-?\d{1,3}(?:\.\d+)?)"
    first, second = number(capture(source, pair, 1)), number(capture(source, pair, 2))
    both = first.isNotNull()
    one_zip = ~both & (F.size("zip_codes") == 1)
    df = df.withColumn("_pair", geo.normalize_pair(first, second))
    return df.withColumns({
        "anchor_type": F.when(both, F.lit("coordinates")).when(one_zip, F.lit("zip_code")),
        "anchor_lat": F.when(both, F.col("_pair.lat")), "anchor_lon": F.when(both, F.col("_pair.lon")),
        "anchor_zip": F.when(one_zip, F.substring(F.element_at("zip_codes", 1), 1, 5)),
    }).drop("_pair", "_named")


def extract_supplier_criteria(requests: DataFrame, text: str = "request_text") -> DataFrame:
    source, lowered = F.col(text), F.lower(text)
    states = state_matches(source)
    certs = [("R2", ["r2"]), ("e-Stewards", ["e-stewards"]), ("NAID AAA", ["naid"])]
    return requests.withColumn("_named", states).withColumns({
        "states": F.col("_named.name"), "state_codes": F.col("_named.code"),
        "zip_codes": F.array_distinct(F.regexp_extract_all(source, F.lit(rules.ZIP_PATTERN), F.lit(0))),
        "supplier_types": token_labels(lowered, rules.SUPPLIER_TYPE_TOKENS),
        "equipment_types": token_labels(lowered, rules.REQUEST_EQUIPMENT_TOKENS),
        "certifications": token_labels(lowered, certs),
        "data_center_decommissioning": contains_any(lowered, ["数据中心退役", "data center"]),
        "bulk_sales": contains_any(lowered, ["bulk", "批量", "wholesale"]),
        "wholesale": contains_any(lowered, ["wholesale", "批发"]),
        "direct_asset_purchasing": contains_any(lowered, ["一手", "direct", "buyer", "采购"]),
    }).drop("_named")


# ------------------------------------------------------------- terms and grids

def expanded_terms(property_types: Column) -> Column:
    """Synonyms of each property type in order; unknown types stand for themselves."""
    table = F.create_map(*[
        x for name, terms in rules.PROPERTY_TERMS for x in (F.lit(name), F.array(*[F.lit(t) for t in terms]))])
    mapped = F.array_distinct(F.flatten(F.transform(
        property_types, lambda p: F.coalesce(F.try_element_at(table, p), F.array(p)))))
    return _array_or(mapped, rules.DEFAULT_PROPERTY_TYPES)


def term_expansion(requests: DataFrame, property_types: str = "property_types") -> DataFrame:
    """One row per request and search term, with its position."""
    return requests.select(
        *[c for c in requests.columns if c != property_types],
        F.posexplode(expanded_terms(F.col(property_types))).alias("term_pos", "term"))


def prioritized_terms(property_types: Column, fallback: list[str] = ()) -> Column:
    """Property types first, then their synonyms, then the fallback terms."""
    return F.array_distinct(F.concat(
        property_types, expanded_terms(property_types), F.array(*[F.lit(t) for t in fallback]).cast("array<string>")))


def profile_lookup(criteria: DataFrame, state_code: str = "state_code") -> DataFrame:
    """Search regions of the state; states without a profile keep one row without a region."""
    rows = [(r[0], i, r[2], r[3], r[4], r[5], r[6]) for i, r in enumerate(rules.SITE_REGIONS)]
    table = F.broadcast(criteria.sparkSession.createDataFrame(
        rows, "p_code string, region_ord int, region_name string, region_type string, cities array<string>, "
              "counties array<string>, search_phrases array<string>"))
    return criteria.join(table, F.upper(state_code) == F.col("p_code"), "left").drop("p_code")


def _first_by_text(queries: Column) -> Column:
    """Drop later queries with the same text in any case."""
    lowered = F.transform(queries, lambda q: F.lower(q["query"]))
    return once(lowered, lambda texts: F.filter(queries, lambda q, i: F.array_position(texts, F.get(texts, i)) == i + 1))


def _filled(df: DataFrame, items: Column, keep: list[str]) -> DataFrame:
    """Rows with a filled array ``_items``: an explode would test its input for emptiness by computing it once more."""
    return keep_rows(df.select(*keep, items.alias("_items")), F.size("_items") > 0)


def _explode_queries(df: DataFrame, queries: Column, keep: list[str]) -> DataFrame:
    return _filled(df, queries, keep).select(*keep, F.posexplode("_items").alias("pos", "_q")).select(*keep, "pos", "_q.*")


def hardware_queries(terms_each: int | None = 2) -> Column:
    """Array of queries, category x source x term x state; all terms of a category, or the first ``terms_each``.

    ``state_names`` is an array of state names or codes; empty means no state.
    """
    names = F.create_map(*[F.lit(x) for name, code in rules.HARDWARE_STATE_NAMES for x in (code, name)])
    cleaned = F.filter(F.transform(F.col("state_names"), lambda s: F.trim(s)), lambda s: s != "")
    suffixes = F.transform(cleaned, lambda s: F.coalesce(F.try_element_at(names, F.upper(s)), s))
    suffixes = F.when(F.size(suffixes) > 0, suffixes).otherwise(F.array(F.lit("")))
    cells = F.array(*[
        F.struct(F.lit(category).alias("category"), F.lit(ci).alias("category_ord"), F.lit(source).alias("source_group"),
                 F.lit(si).alias("source_ord"),
                 F.lit(f"site:{domain} {term}" if domain else f"{term} auction surplus liquidation").alias("stem"))
        for ci, (category, terms) in enumerate(rules.CATEGORY_SEARCH_TERMS.items())
        for si, (source, domain) in enumerate(rules.HARDWARE_SOURCES) for term in terms[:terms_each]])
    return F.flatten(F.transform(cells, lambda c: F.transform(suffixes, lambda s: F.struct(
        c["category"].alias("category"), c["category_ord"].alias("category_ord"),
        c["source_group"].alias("source_group"), c["source_ord"].alias("source_ord"),
        F.trim(F.concat(c["stem"], F.lit(" "), s)).alias("query")))))


def hardware_grid(requests: DataFrame, keep: list[str], terms_each: int | None = 2) -> DataFrame:
    """One row per query of ``hardware_queries``."""
    return _explode_queries(requests, hardware_queries(terms_each), keep)


# ------------------------------------------------------------- choice inside the row
#
# The queries of a request are an array in its row. A choice sorts rank structs in the row and explodes what is left, so
# it needs no shuffle and no window, and a request costs the same however many there are.

def _placed(queries: Column) -> Column:
    """Queries with their place."""
    return F.transform(queries, lambda q, i: F.struct(i.alias("pos"), q.alias("q")))


def _picks(ranked: Column, limit: int | None) -> Column:
    """Sorted rank structs, cut, with their number from 1."""
    ordered = F.array_sort(ranked)
    if limit is not None:
        ordered = F.slice(ordered, 1, limit)
    return F.transform(ordered, lambda x, i: F.struct((i + 1).alias("pick"), x["pos"].alias("pos"), x["q"].alias("q")))


def _explode_picks(df: DataFrame, picks: Column, keep: list[str]) -> DataFrame:
    return _filled(df, picks, keep).select(*keep, F.explode("_items").alias("_p")).select(*keep, "_p.pick", "_p.pos", "_p.q.*")


def _distinct(queries: Column, name: str) -> Column:
    """Values of a field in the order they come up."""
    return F.array_distinct(F.transform(queries, lambda x: x["q"][name]))


def round_robin_cap(requests: DataFrame, queries: Column, keep: list[str], limit: int | None = None) -> DataFrame:
    """Take queries from the sources in turn, per request and category; all of them, or up to the limit."""
    def category(placed: Column, name: Column) -> Column:
        mine = F.filter(placed, lambda x: x["q"]["category"] == name)
        turns = once(mine, lambda m: F.flatten(F.transform(_distinct(m, "source_group"), lambda g: F.transform(
            F.filter(m, lambda x: x["q"]["source_group"] == g),
            lambda x, turn: F.struct(turn.alias("turn"), x["q"]["source_ord"].alias("ord"), x["pos"].alias("pos"), x["q"].alias("q"))))))
        return _picks(turns, limit)

    picks = once(_placed(queries), lambda p: F.flatten(F.transform(_distinct(p, "category"), lambda c: category(p, c))))
    return _explode_picks(requests, picks, keep)


def _county_phrase(county: Column) -> Column:
    trimmed = F.trim(county)
    return F.when(F.lower(trimmed).endswith(" county"), trimmed).otherwise(F.concat(trimmed, F.lit(" County")))


_GRID_INPUTS = {
    "counties": "array<string>", "cities": "array<string>", "zip_codes": "array<string>", "min_land_acres": "double",
    "max_price_usd": "double", "anchor_type": "string", "anchor_city": "string", "anchor_county": "string",
    "anchor_state": "string", "anchor_zip": "string", "anchor_lat": "double", "anchor_lon": "double",
    "anchor_radius_miles": "double",
}


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _suffix(value: Column, text: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, text).otherwise(F.lit(""))


def _query(text: Column, group: str | Column, state: Column, property_type: Column | None = None,
           region: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.trim(text).alias("query"), (F.lit(group) if isinstance(group, str) else group).alias("source_group"),
        state.alias("query_state"), (none if property_type is None else property_type).alias("property_type"),
        (none if region is None else region).alias("region_name"))


def with_site_queries(criteria: DataFrame, limit: int | None = None, terms: int | None = None) -> DataFrame:
    """Add ``_queries``, the standard search queries: places x terms plus five group queries per place.

    All of them, or the first ``limit`` of the first ``terms`` terms.
    """
    df = with_missing(criteria, _GRID_INPUTS)
    c, none = F.col, F.lit(None).cast("string")
    empty = F.array().cast("array<string>")

    def place(state: Column, phrase: Column) -> Column:
        return F.struct(state.alias("state"), phrase.alias("phrase"))

    anchored = c("anchor_type").isNotNull()
    six = "%.6f"
    zip_phrase = F.when(
        c("anchor_city").isNotNull() & c("anchor_state").isNotNull(),
        F.concat_ws(" ", F.lit("near"), c("anchor_zip"), c("anchor_city"), c("anchor_state"))
    ).otherwise(F.concat(F.lit("near ZIP "), c("anchor_zip")))
    anchors = F.array_compact(F.array(
        F.when(anchored & c("anchor_city").isNotNull() & c("anchor_state").isNotNull(), place(
            c("anchor_state"), F.concat_ws(" ", F.lit("near"), c("anchor_city"), c("anchor_state")))),
        F.when(anchored & c("anchor_county").isNotNull() & c("anchor_state").isNotNull(), place(
            c("anchor_state"), F.concat_ws(" ", F.lit("near"), _county_phrase(c("anchor_county")), c("anchor_state")))),
        F.when(anchored & c("anchor_zip").isNotNull(), place(c("anchor_state"), zip_phrase)),
        F.when(anchored & c("anchor_lat").isNotNull() & c("anchor_lon").isNotNull(), place(
            c("anchor_state"), F.concat(F.lit("near "), F.format_string(six, c("anchor_lat")), F.lit(", "),
                                        F.format_string(six, c("anchor_lon"))))),
    ))
    by_state = F.flatten(F.transform(F.coalesce(c("states"), empty), lambda s: F.concat(
        F.array(place(s, s)),
        F.transform(F.coalesce(c("counties"), empty), lambda k: place(s, F.concat_ws(" ", _county_phrase(k), s))),
        F.transform(F.coalesce(c("cities"), empty), lambda k: place(s, F.concat_ws(" ", k, s))))))
    places = F.concat(anchors, by_state)
    by_zip = F.transform(F.coalesce(c("zip_codes"), empty), lambda z: place(none, z))
    places = F.when(F.size(places) > 0, places).when(F.size(by_zip) > 0, by_zip).otherwise(
        F.array(place(none, F.lit("United States"))))
    df = df.withColumns({
        "_places": places, "_terms": _first(prioritized_terms(c("property_types")), terms),
        "_tail": F.concat(
            _suffix(c("min_land_acres"), F.concat(F.lit(" "), labels.plain_number(c("min_land_acres")), F.lit("+ acres"))),
            _suffix(c("max_price_usd"), F.concat(F.lit(" under "), labels.money(c("max_price_usd")))),
            _suffix(c("anchor_radius_miles"), F.concat(
                F.lit(" within "), labels.plain_number(c("anchor_radius_miles")), F.lit(" miles")))),
        "_deal": F.coalesce(F.try_element_at("transaction_types", F.lit(1)), F.lit("for sale")),
    })

    def of_place(p: Column) -> Column:
        s, phrase = p["state"], p["phrase"]
        wide = F.coalesce(s, phrase)
        market = F.transform(F.col("_terms"), lambda t: _query(
            F.concat(t, F.lit(" "), F.col("_deal"), F.lit(" "), phrase, F.col("_tail")), "property_market", s, t))
        return F.concat(market, F.array(
            _query(F.concat(F.lit("economic development available sites "), phrase), "economic_development", s),
            _query(F.concat(F.lit("industrial park available buildings "), phrase), "industrial_park", s),
            _query(F.concat(F.lit("commercial real estate industrial broker "), phrase), "local_brokerage", s),
            _query(F.concat(F.lit("powered land for data center "), wide), "utility", s),
            _query(F.concat(F.lit("shovel-ready industrial site "), wide), "economic_development", s)))

    df = df.withColumn("_queries", F.flatten(F.transform(F.col("_places"), of_place)))
    return df.withColumn("_queries", _first(_first_by_text(F.col("_queries")), limit)).drop("_places", "_terms", "_tail", "_deal")


def site_grid(criteria: DataFrame, keep: list[str], limit: int | None = None, terms: int | None = None) -> DataFrame:
    """One row per query of ``with_site_queries``."""
    return _explode_queries(with_site_queries(criteria, limit, terms), F.col("_queries"), keep)


def _region_phrases(region: tuple) -> list[str]:
    _, state, _, _, cities, counties, phrases = region
    extra = [f"{city} {state}" for city in cities[:2]] + [f"{county} County {state}" for county in counties[:2]]
    return list(dict.fromkeys([*phrases, *extra]))[:4]


def with_state_queries(criteria: DataFrame) -> DataFrame:
    """Add ``_queries``: region queries of the states that have a search profile, then the statewide ones.

    Requests with an anchor or without a profile are left out.
    """
    df = with_missing(criteria, _GRID_INPUTS)
    c = F.col
    regions = F.array(*[
        F.struct(F.lit(r[0]).alias("code"), F.lit(r[1]).alias("state"), F.lit(r[2]).alias("name"),
                 F.array(*[F.lit(p) for p in _region_phrases(r)]).alias("phrases")) for r in rules.SITE_REGIONS])
    statewide = F.array(*[
        F.struct(F.lit(group).alias("source_group"), F.lit(text).alias("query"))
        for group, text in rules.SITE_STATEWIDE_QUERIES])
    code = F.upper(F.try_element_at("state_codes", F.lit(1)))
    df = df.filter(c("anchor_type").isNull() & code.isin(sorted({r[0] for r in rules.SITE_REGIONS})))
    df = df.withColumns({
        "_terms": F.slice(prioritized_terms(c("property_types"), rules.STATE_SEARCH_FALLBACK_TERMS), 1, 4),
        "_tail": F.concat(
            _suffix(c("min_land_acres"), F.concat(F.lit(" "), labels.plain_number(c("min_land_acres")), F.lit("+ acres"))),
            _suffix(c("max_price_usd"), F.concat(F.lit(" under "), labels.money(c("max_price_usd"))))),
        "_deal": F.coalesce(F.try_element_at("transaction_types", F.lit(1)), F.lit("for sale")),
        "_regions": F.filter(regions, lambda r: r["code"] == code),
    })

    def of_phrase(r: Column, phrase: Column) -> Column:
        market = F.transform(F.col("_terms"), lambda t: _query(
            F.concat(t, F.lit(" "), F.col("_deal"), F.lit(" "), phrase, F.col("_tail")),
            "state_region_property_market", r["state"], t, r["name"]))
        return F.concat(market, F.array(
            _query(F.concat(F.lit("industrial acreage "), phrase), "state_region_property_market", r["state"], None, r["name"]),
            _query(F.concat(F.lit("commercial real estate industrial broker "), phrase), "state_region_local_brokerage",
                   r["state"], None, r["name"])))

    regional = F.flatten(F.transform(F.col("_regions"), lambda r: F.flatten(
        F.transform(r["phrases"], lambda p: of_phrase(r, p)))))
    general = F.transform(statewide, lambda q: _query(
        q["query"], q["source_group"], F.get(F.col("_regions"), F.lit(0))["state"], None, F.lit("Statewide")))
    df = df.withColumn("_queries", F.concat(regional, general))
    return df.withColumn("_queries", _first_by_text(F.col("_queries"))).drop("_terms", "_tail", "_deal", "_regions")


def state_grid(criteria: DataFrame, keep: list[str]) -> DataFrame:
    """One row per query of ``with_state_queries``."""
    return _explode_queries(with_state_queries(criteria), F.col("_queries"), keep)


def supplier_grid(criteria: DataFrame, keep: list[str]) -> DataFrame:
    """Supplier queries per region and statewide; states without a profile get general ones."""
    c = F.col
    regions = F.array(*[
        F.struct(F.lit(r[0]).alias("code"), F.lit(r[1]).alias("state"), F.lit(r[2]).alias("name"),
                 F.array(*[F.lit(p) for p in r[4][:2]]).alias("phrases")) for r in rules.SUPPLIER_REGIONS])
    code = F.upper(F.try_element_at("state_codes", F.lit(1)))
    terms = F.array_distinct(F.concat(c("supplier_types"), F.array(*[F.lit(t) for t in rules.DEFAULT_SUPPLIER_TYPES])))
    df = criteria.withColumns({
        "_terms": terms, "_regions": F.filter(regions, lambda r: r["code"] == F.coalesce(code, F.lit(""))),
        "_states": F.when(F.size("states") > 0, c("states")).otherwise(F.array(F.lit("United States"))),
    })
    regional = F.flatten(F.transform(c("_regions"), lambda r: F.flatten(F.transform(r["phrases"], lambda p: F.transform(
        F.slice(F.col("_terms"), 1, 5), lambda t: _query(
            F.concat(t, F.lit(" "), p), "regional_supplier_search", r["state"], t, r["name"]))))))
    statewide = F.array(*[
        _query(F.lit(q), "statewide_supplier_search", F.lit("Texas"), None, F.lit("Statewide"))
        for q in rules.SUPPLIER_STATEWIDE_QUERIES])
    general = F.flatten(F.transform(c("_states"), lambda s: F.transform(F.slice(F.col("_terms"), 1, 8), lambda t: _query(
        F.concat(t, F.lit(" "), s), "supplier_search", s, t))))
    df = df.withColumn(
        "_queries", F.when(F.size("_regions") > 0, F.concat(regional, statewide)).otherwise(general))
    return _explode_queries(df, _first_by_text(c("_queries")), keep)


def top_queries_per_region(requests: DataFrame, queries: Column, keep: list[str], limit: int | None = None, brokers: bool = True) -> DataFrame:
    """Two queries per region, then the statewide groups, then one brokerage per region; all of these, or up to the limit."""
    def ranked(x: Column, tier: int, second: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), second.alias("second"), x["pos"].alias("pos"), x["q"].alias("q"))

    def region(m: Column, at: Column) -> Column:
        best = F.transform(F.slice(m, 1, 2), lambda x: ranked(x, 1, at))
        if not brokers:
            return best
        rest = F.filter(F.slice(m, 3, F.greatest(F.size(m), F.lit(1))), lambda x: x["q"]["source_group"] == "state_region_local_brokerage")
        return F.concat(best, F.transform(F.slice(rest, 1, 1), lambda x: ranked(x, 3, at)))

    def wide(m: Column) -> Column:
        return F.transform(m, lambda x: ranked(x, 2, F.when(x["q"]["source_group"] == "state_utility", F.lit(1)).otherwise(F.lit(0))))

    def chosen(placed: Column) -> Column:
        named = F.filter(placed, lambda x: x["q"]["region_name"].isNotNull())
        return once(named, lambda p: F.flatten(F.transform(_distinct(p, "region_name"), lambda r, at: once(
            F.filter(p, lambda x: x["q"]["region_name"] == r), lambda m: F.when(r == "Statewide", wide(m)).otherwise(region(m, at))))))

    return _explode_picks(requests, _picks(once(_placed(queries), chosen), limit), keep)


_PRIORITY_GROUPS = ["economic_development", "industrial_park", "utility", "local_brokerage"]


def priority_pick(requests: DataFrame, queries: Column, keep: list[str], limit: int | None = None) -> DataFrame:
    """Per state: a market query, one for industrial land, one per source group; then the rest in order."""
    def ranked(x: Column, rest: int, state: Column, tier: int) -> Column:
        return F.struct(F.lit(rest).alias("rest"), state.alias("state"), F.lit(tier).alias("tier"), x["pos"].alias("pos"), x["q"].alias("q"))

    def state(m: Column, at: Column) -> Column:
        def first(items: Column, tier: int) -> Column:
            return F.transform(F.slice(items, 1, 1), lambda x: ranked(x, 0, at, tier))

        market = F.filter(m, lambda x: x["q"]["source_group"] == "property_market")
        land = F.filter(F.slice(market, 2, F.greatest(F.size(market), F.lit(1))), lambda x: F.lower(x["q"]["query"]).contains("industrial land"))
        def of_group(name: str) -> Column:
            return F.filter(m, lambda x: x["q"]["source_group"] == name)

        return F.concat(first(market, 1), first(land, 2), *[first(of_group(g), 3 + i) for i, g in enumerate(_PRIORITY_GROUPS)])

    def ordered(placed: Column) -> Column:
        stated = F.exists(placed, lambda x: x["q"]["query_state"].isNotNull())
        picked = F.flatten(F.transform(_distinct(placed, "query_state"), lambda s, at: once(
            F.filter(placed, lambda x: x["q"]["query_state"].eqNullSafe(s) & (s.isNotNull() | ~stated)), lambda m: state(m, at))))
        return once(picked, lambda p: F.concat(p, F.transform(
            F.filter(placed, lambda x: ~F.array_contains(F.transform(p, lambda y: y["pos"]), x["pos"])), lambda x: ranked(x, 1, F.lit(0), 0))))

    return _explode_picks(requests, _picks(once(_placed(queries), ordered), limit), keep)
