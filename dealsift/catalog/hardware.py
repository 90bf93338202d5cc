"""Hardware listing queries."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog.records import cte, record
from dealsift.catalog.registry import (AS_OF, distinct_list, domain_sql, flags, has, hit, in_list, joined, joined_sql,
                                       label_case, label_list, num, path_sql, q, query, rx, stamp, stamp_sql, url_part)
from dealsift.operators import classify, dedupe, funnel, hardware, lifecycle
from dealsift.plans import scans
from dealsift.session import shared_folder
from dealsift.sources.hits import as_hits
from dealsift.sources.tables import read_snapshot, write_snapshot

ORDER = ["observed_at", "listing_no", "part_no", "supp_no", "amount"]
TRAIL = ", ".join(ORDER)


# ---------------------------------------------------------------- inputs

def hits_of(spark, sf_dir: str, name: str = "listing_src") -> DataFrame:
    df = record(spark, sf_dir, name)
    from dealsift.functions import url
    return df.withColumns({"domain": url.domain(F.col("source_url")), "detail_checked_at": F.col("observed_at")})


def normalized(spark, sf_dir: str, name: str = "listing_src") -> DataFrame:
    return hardware.normalize_hardware(hits_of(spark, sf_dir, name), AS_OF)


def _parts_sql(src: str) -> str:
    return f"""parts AS (SELECT *, {domain_sql('source_url')} AS domain, {path_sql('source_url')} AS path,
  {url_part('source_url', 4)} AS qry, {url_part('source_url', 1)} AS scheme,
  original_title || ' ' || coalesce(original_description, '') AS text,
  lower(original_title || ' ' || coalesce(original_description, '')) AS low FROM {src})"""


def _kept_params() -> str:
    cases = []
    for name in rules.URL_KEPT_PARAMS:
        raw = f"regexp_extract(qry, '(?:^|&){name}=([^&]+)', 1)"
        cases.append(f"CASE WHEN {raw} <> '' THEN '{name}=' || replace(url_encode(url_decode(replace({raw}, '+', ' '))), '%20', '+') END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '&')"


def _canonical_sql() -> str:
    trimmed = "regexp_replace(path, '/+$', '')"
    item = f"regexp_extract({trimmed}, '/itm/(?:[^/]+/)?(\\d{{10,}})', 1)"
    where = f"CASE WHEN contains(domain, 'ebay.com') AND {item} <> '' THEN '/itm/' || {item} ELSE {trimmed} END"
    return f"""canon AS (SELECT *, coalesce(nullif(scheme, ''), 'https') || '://' || domain ||
  CASE WHEN ({where}) LIKE '/%' THEN ({where}) ELSE '/' || ({where}) END ||
  CASE WHEN {_kept_params()} <> '' THEN '?' || {_kept_params()} ELSE '' END AS canonical_url FROM parts)"""


def _page_sql() -> str:
    lot = "(" + " OR ".join(hit("low", p) for p in rules.PAGE_LOT_PATTERNS) + ")"
    tails = "(" + " OR ".join(f"ends_with(domain, {q(d)})" for d in rules.PAGE_BLOCKED_DOMAINS) + ")"
    lp = "lower(path)"

    def asks(*names):
        return "(" + " OR ".join(f"regexp_extract(qry, '(?:^|&){n}=([^&]+)', 1) <> ''" for n in names) + ")"

    specific = f"""((contains(domain, 'govdeals.com') AND regexp_matches({lp}, '/(en/)?asset/[0-9]+'))
      OR (contains(domain, 'ebay.com') AND (contains({lp}, '/itm/') OR regexp_matches({lp}, '/[0-9]{{10,}}$')))
      OR (contains(domain, 'publicsurplus.com') AND ({asks('auc', 'auction')} OR contains({lp}, 'view')))
      OR (contains(domain, 'hgpauction.com') AND {has(lp, rules.PAGE_HOUSE_LOT_PATHS)} AND {lot})
      OR ({lot} AND {has(lp, rules.PAGE_LOT_PATHS)}))"""
    steps = [
        (f"{tails} OR {has('low', rules.PAGE_BLOCKED_TEXT)}", "irrelevant", "blocked"),
        (f"{has(lp, rules.PAGE_NEWS_PATHS)} OR {has('low', rules.PAGE_NEWS_TEXT)}", "news_or_article", "news"),
        (specific, "specific_listing", "specific"),
        (f"{has(lp, rules.PAGE_COLLECTION_PATHS)} OR {asks(*rules.PAGE_COLLECTION_PARAMS)} OR {has('low', rules.PAGE_COLLECTION_TEXT)}",
         "listing_collection", "collection"),
        (f"{has(lp, rules.PAGE_SOURCE_PATHS)} OR ({has('low', rules.PAGE_SOURCE_TEXT)} AND NOT {lot})", "source_page", "source"),
        (f"{lot} AND source_name IN {in_list(rules.MARKETPLACES)}", "specific_listing", "marketplace"),
    ]
    case = " ".join(f"WHEN {c} THEN {q(k + '#' + rules.PAGE_REASONS[r])}" for c, k, r in steps)
    none = q("irrelevant#" + rules.PAGE_REASONS["none"])
    return f"""paged AS (SELECT *, split_part(verdict, '#', 1) AS page_type, split_part(verdict, '#', 2) AS classification_reason
  FROM (SELECT *, CASE {case} ELSE {none} END AS verdict FROM canon))"""


def _maker_model() -> tuple[str, str]:
    maker, model = [], []
    for pattern, fixed in rules.MAKER_MODEL_PATTERNS:
        cond = hit("text", pattern)
        maker.append(f"WHEN {cond} THEN {q(fixed) if fixed else 'trim(' + rx('text', pattern, 1) + ')'}")
        model.append(f"WHEN {cond} THEN trim(regexp_replace({rx('text', pattern, 2)}, '\\s+', ' ', 'g'))")
    model.append(f"WHEN category = 'memory' AND {hit('text', rules.MEMORY_MODEL_PATTERN)} THEN upper({rx('text', rules.MEMORY_MODEL_PATTERN)})")
    model.append(f"WHEN category = 'storage' AND {hit('text', rules.STORAGE_MODEL_PATTERN)} THEN {rx('text', rules.STORAGE_MODEL_PATTERN)}")
    return "CASE " + " ".join(maker) + " END", "CASE " + " ".join(model) + " END"


def _detail_sql(kind: str, arg) -> str:
    if kind == "match":
        return f"trim(regexp_replace({rx('text', arg, 0)}, '\\s+', ' ', 'g'))"
    if kind == "int":
        return f"CAST(try_cast({rx('text', arg)} AS BIGINT) AS VARCHAR)"
    if kind == "dual_or_int":
        return f"CASE WHEN {hit('text', arg[0])} THEN '2' ELSE CAST(try_cast({rx('text', arg[1])} AS BIGINT) AS VARCHAR) END"
    if kind == "has":
        return f"CAST({has('low', arg)} AS VARCHAR)"
    if kind == "lacks":
        return f"CAST(NOT {has('low', arg)} AS VARCHAR)"
    if kind == "has_unless":
        return f"CAST(contains(low, {q(arg[0])}) AND NOT contains(low, {q(arg[1])}) AS VARCHAR)"
    if kind == "capacity_tb":
        tb, gb = rx("text", r"\b(\d+(?:\.\d+)?)\s?TB\b"), rx("text", r"\b(\d{3,5})\s?GB\b")
        return f"CAST(coalesce(CAST({tb} AS DOUBLE), round(CAST({gb} AS DOUBLE) / 1024, 3)) AS VARCHAR)"
    return "CASE WHEN contains(low, 'tray') THEN 'tray' ELSE 'individual' END"


def _details() -> str:
    def listed(entries):
        items = ", ".join(f"{q(k + '=')} || nullif({v}, '')" for k, v in entries)
        return f"list_filter([{items}], lambda x: x IS NOT NULL)"

    common = [("parsed_from", "'title_description_rules'"), ("quantity", "CAST(nullif(quantity, 0) AS VARCHAR)")]
    cases = " ".join(
        f"WHEN category = {q(c)} THEN {listed(common + [(k, _detail_sql(kind, arg)) for k, kind, arg in parts])}"
        for c, parts in rules.COMPONENT_RULES.items())
    return f"CASE {cases} ELSE {listed(common)} END"


_CONFIG = f"regexp_extract_all(text, {q('(?i)' + rules.SPEC_PATTERN)})"
_MAKER, _MODEL = _maker_model()


def norm_sql(src: str, extra: str = "", pages: str = "paged", more: str = "", given: dict[str, str] | None = None) -> str:
    """CTE chain from a record view to ``norm`` and ``scored``.

    ``more`` are CTEs behind ``paged`` that end in ``pages``; ``given`` names the expressions of detail fields, which win over text.
    """
    given = given or {}

    def wins(name: str, text: str) -> str:
        return f"coalesce({given[name]}, {text})" if name in given else text

    review = given.get("needs_manual_review", "false")
    completeness = "CASE " + " ".join(
        [f"WHEN {has('low', t)} THEN {q(v)}" for v, t in rules.COMPLETENESS_BEFORE_FLAGS]
        + [f"WHEN list_contains(risk_flags, {q(f)}) THEN {q(v)}" for f, v in rules.COMPLETENESS_FLAGS]
        + [f"WHEN {has('low', t)} THEN {q(v)}" for v, t in rules.COMPLETENESS_AFTER_FLAGS]) + " ELSE 'unknown' END"
    premium = rx("text", rules.BUYER_PREMIUM_PATTERN)
    states = "CASE " + " ".join(
        f"WHEN {hit('text', chr(92) + 'b' + n + chr(92) + 'b|' + chr(92) + 'b' + c + chr(92) + 'b')} THEN {q(c)}"
        for n, c in rules.HARDWARE_STATE_NAMES) + " END"
    raw_flags = label_list("low", rules.RISK_FLAG_TOKENS)
    sub = ("CASE WHEN category = 'gpu' THEN CASE WHEN contains(low, 'h100') THEN 'H100' WHEN contains(low, 'a100') THEN 'A100' "
           "WHEN contains(low, 'rtx') THEN 'RTX' END WHEN category = 'servers' THEN 'rack_server' WHEN category = 'memory' THEN 'ecc_rdimm' "
           "WHEN category = 'storage' THEN 'enterprise_storage' WHEN category = 'cpu' THEN 'server_cpu' END")
    gate, src_name = "source_name", "lower(source_name)"
    return f"""{cte(src)}, {_parts_sql(src)}, {_canonical_sql()}, {_page_sql()},{more}
n1 AS (SELECT *, original_title AS title,
  {wins('total_price', num(rx('text', rules.DOLLAR_PATTERN)))} AS total_price,
  coalesce({', '.join(f'try_cast({rx("text", p)} AS BIGINT)' for p in rules.QUANTITY_PATTERNS)}) AS quantity,
  {premium} || '%' AS buyer_premium,
  {_MAKER} AS manufacturer, {_MODEL} AS model, {sub} AS subcategory,
  upper({rx('text', rules.PART_NUMBER_PATTERN)}) AS part_number, {rx('text', rules.GENERATION_PATTERN)} AS generation,
  CASE WHEN len({_CONFIG}) > 0 THEN array_to_string({distinct_list(_CONFIG + '[1:8]')}, ', ') END AS configuration,
  {wins('listing_status', f"CASE WHEN {has('low', rules.ENDED_TEXT)} THEN 'ended' WHEN {has('low', rules.ACTIVE_TEXT)} THEN 'active' ELSE 'unknown' END")} AS listing_status,
  {label_case('low', rules.CONDITION_TOKENS, "'unknown'")} AS condition,
  CASE WHEN contains(low, 'working') THEN 'claimed_working' WHEN {has('low', ['not working', 'broken'])} THEN 'not_working' ELSE 'unknown' END AS working_status,
  CASE WHEN contains(low, 'untested') THEN 'untested' WHEN contains(low, 'tested') THEN 'tested' ELSE 'unknown' END AS testing_status,
  CASE WHEN {has(src_name, ['gov', 'public surplus'])} THEN 'government_surplus' WHEN contains(low, 'auction') OR contains({src_name}, 'auction') THEN 'auctioneer'
    WHEN {has('low', ['itad', 'asset disposition'])} THEN 'itad_supplier' ELSE 'unknown' END AS seller_type,
  CASE WHEN domain IN {in_list(rules.MARKETPLACE_DOMAINS)} THEN 'marketplace_listing' WHEN {gate} IN {in_list(rules.MARKETPLACES)} THEN 'public_search_discovery'
    ELSE 'needs_verification' END AS confidence_level,
  {wins('location_state', states)} AS location_state, {wins('pickup_only', has('low', ['pickup only', 'local pickup']))} AS pickup_only,
  {wins('shipping_available', "CASE WHEN contains(low, 'shipping') THEN NOT contains(low, 'no shipping') END")} AS shipping_available
  FROM {pages} {extra}),
n2 AS (SELECT *, {distinct_list(f"list_concat({raw_flags}, CASE WHEN {review} THEN ['needs_manual_review'] ELSE [] END, CASE WHEN buyer_premium IS NOT NULL THEN ['buyer_premium'] ELSE [] END)")} AS risk_flags,
  {_details()} AS details FROM n1),
norm AS (SELECT *, {completeness} AS component_completeness,
  {wins('current_price', 'total_price')} AS current_price, {wins('current_cost', 'total_price')} AS current_total_cost,
  CASE WHEN total_price <> 0 AND quantity > 0 THEN CAST(round(CAST(CAST(total_price / quantity AS VARCHAR) AS DECIMAL(30,12)), 2) AS DOUBLE) END AS cost_per_unit,
  CASE WHEN category = 'memory' AND total_price <> 0 AND quantity > 0 AND CAST({rx('text', rules.COMPONENT_RULES['memory'][0][2])} AS DOUBLE) > 0
    THEN CAST(round(CAST(CAST(total_price / (CAST({rx('text', rules.COMPONENT_RULES['memory'][0][2])} AS DOUBLE) * quantity) AS VARCHAR) AS DECIMAL(30,12)), 4) AS DOUBLE) END AS cost_per_gb,
  CASE WHEN total_price <> 0 AND quantity <> 0 THEN 'high' WHEN total_price <> 0 THEN 'medium' ELSE 'unknown' END AS cost_confidence,
  {review} OR listing_status IN ('unknown', 'needs_manual_review') AS needs_manual_review,
  domain || regexp_replace(regexp_replace({url_part('canonical_url', 3)}, ';[^/]*$', ''), '/+$', '') ||
    CASE WHEN {url_part('canonical_url', 4)} <> '' THEN '?' || {url_part('canonical_url', 4)} ELSE '' END AS opportunity_key,
  CASE WHEN listing_status = 'sold' THEN 'sold' WHEN listing_status IN ('ended', 'removed', 'unavailable') THEN 'ended' WHEN listing_status IN ('active', 'ending_soon') THEN 'active' ELSE 'needs_verification' END AS status
  FROM n2)"""


def score_sql(src: str = "norm") -> str:
    inc, risky = in_list(rules.INCOMPLETE_VALUES), in_list(rules.RISKY_CONDITIONS)
    good, weak, sell = in_list(rules.GOOD_CONDITIONS), in_list(rules.WEAK_CONDITIONS), in_list(rules.SOURCING_SELLERS)
    t = rules.SCORE_REASONS
    clear = "(contains(lower(title), category) OR coalesce(model, '') <> '')"
    priced = "coalesce(total_price <> 0, false)"
    bulk = "coalesce(quantity >= 5, false)"
    return f"""s1 AS (SELECT *, listing_status IN {in_list(rules.DEAD_STATUSES)} AS dead, listing_status = 'needs_manual_review' AS rev,
  {clear} AS c_clear, {priced} AS c_priced, {bulk} AS c_bulk FROM {src}),
s2 AS (SELECT *, CAST(CASE WHEN dead OR rev THEN 0 ELSE least(100,
    CASE WHEN c_clear THEN 20 ELSE 0 END + CASE WHEN c_bulk THEN 15 ELSE 0 END + CASE WHEN c_priced THEN 15 ELSE 0 END
    + CASE WHEN condition IN {good} THEN 15 WHEN condition IN {weak} THEN 4 ELSE 0 END + CASE WHEN seller_type IN {sell} THEN 15 ELSE 0 END
    + CASE WHEN coalesce(shipping_available, false) OR pickup_only = false THEN 8 ELSE 0 END + CASE WHEN location_state IS NOT NULL THEN 5 ELSE 0 END
    + CASE WHEN confidence_level = 'marketplace_listing' THEN 7 ELSE 0 END + CASE WHEN listing_status = 'ending_soon' THEN 5 ELSE 0 END) END AS DOUBLE) AS opportunity_score,
  CAST(CASE WHEN listing_status = 'unavailable' THEN 100 WHEN dead THEN 75 WHEN rev THEN 85 ELSE least(100, 12 * len(risk_flags)
    + CASE WHEN condition IN {risky} THEN 25 ELSE 0 END + CASE WHEN component_completeness IN {inc} THEN 15 ELSE 0 END
    + CASE WHEN c_priced THEN 0 ELSE 10 END + CASE WHEN needs_manual_review THEN 10 ELSE 0 END) END AS DOUBLE) AS risk_score FROM s1),
scored AS (SELECT *, CASE WHEN dead THEN 'expired' WHEN rev THEN 'information_incomplete' WHEN risk_score >= 70 THEN 'high_risk'
    WHEN needs_manual_review OR coalesce(quantity, 0) = 0 OR NOT c_priced THEN 'information_incomplete'
    WHEN listing_status = 'ending_soon' AND opportunity_score >= 50 THEN 'urgent_review' WHEN opportunity_score >= 45 THEN 'worth_tracking' ELSE 'ignore' END AS recommendation,
  CASE WHEN dead THEN [{q(t['dead'])}] WHEN rev THEN [{q(t['review'])}] ELSE {flags([
        ('c_clear', t['clear']), ('c_bulk', t['bulk']), ('c_priced', t['price']), (f'condition IN {good}', t['condition']), (f'seller_type IN {sell}', t['seller'])])} END AS score_reasons,
  CASE WHEN dead THEN ['expired_or_unavailable'] WHEN rev THEN ['needs_manual_review'] ELSE {flags([
        ('c_bulk', 'large_quantity'), ('c_priced AND cost_per_unit <> 0 AND cost_per_unit < 500', 'attractive_unit_cost'), (f'condition IN {good}', 'tested_inventory'),
        ("condition = 'untested'", 'unknown_condition'), ("condition IN ('parts_only', 'salvage')", 'salvage_or_parts_only'),
        (f"seller_type IN {sell} AND category <> 'cpu'", 'data_center_grade'), (f"seller_type IN {sell} AND category = 'cpu'", 'auction_source'),
        ('pickup_only', 'pickup_only'), ("listing_status = 'ending_soon'", 'auction_ending_soon'), ('buyer_premium IS NULL', 'buyer_premium_unknown'),
        (f'component_completeness IN {inc}', 'missing_manifest')])} END AS recommendation_reasons FROM s2)"""


LISTED = f"WITH {norm_sql('listing_src')}"
SPEC = f"WITH {norm_sql('spec_src')}"
KEYS = ["listing_no", "part_no", "supp_no"]
KEYS_SQL = ", ".join(KEYS)
_SCORE_COLUMNS = "opportunity_score, risk_score, recommendation"


# ---------------------------------------------------------------- pages and filters

@query("classify_hardware_page", f"{LISTED} SELECT {KEYS_SQL}, page_type, classification_reason FROM paged")
def _(spark, sf):
    return classify.classify_hardware_pages(hits_of(spark, sf)).select(*KEYS, "page_type", "classification_reason")


@query("specific_only", f"{LISTED} SELECT {KEYS_SQL}, source_url FROM paged WHERE page_type = 'specific_listing'")
def _(spark, sf):
    return classify.specific_only(classify.classify_hardware_pages(hits_of(spark, sf))).select(*KEYS, "source_url")


_HAY = "lower(original_title || ' ' || coalesce(original_description, '') || ' ' || domain)"


@query("hardware_relevance", f"{LISTED} SELECT {KEYS_SQL}, source_name FROM parts WHERE NOT {has(_HAY, rules.HARDWARE_BLOCKED)} AND {has(_HAY, rules.HARDWARE_WANTED)}")
def _(spark, sf):
    return classify.hardware_relevance(hits_of(spark, sf)).select(*KEYS, "source_name")


_CAT = " OR ".join(f"(category = {q(c)} AND {has('low', t)})" for c, t in rules.CATEGORY_TOKENS.items())
_VETO = f"((category = 'storage' AND {has('low', rules.STORAGE_VETO)}) OR (category = 'cpu' AND {has('low', rules.CPU_VETO)} AND NOT {has('low', rules.CPU_VETO_UNLESS)}))"


@query("category_relevance", f"{SPEC} SELECT {KEYS_SQL}, category FROM parts WHERE ({_CAT}) AND NOT {_VETO}")
def _(spark, sf):
    return classify.category_relevance(hits_of(spark, sf, "spec_src")).select(*KEYS, "category")


# ---------------------------------------------------------------- projections

@query("condition_tags", f"{SPEC} SELECT {KEYS_SQL}, condition, working_status, testing_status FROM norm")
def _(spark, sf):
    return normalized(spark, sf, "spec_src").select(*KEYS, "condition", "working_status", "testing_status")


@query("seller_and_confidence", f"{LISTED} SELECT {KEYS_SQL}, seller_type, confidence_level FROM norm")
def _(spark, sf):
    return normalized(spark, sf).select(*KEYS, "seller_type", "confidence_level")


@query("risk_flags", f"{SPEC} SELECT {KEYS_SQL}, {joined_sql('risk_flags')} AS risk_flags FROM norm")
def _(spark, sf):
    return normalized(spark, sf, "spec_src").select(*KEYS, joined("risk_flags"))


@query("component_completeness", f"{SPEC} SELECT {KEYS_SQL}, component_completeness FROM norm")
def _(spark, sf):
    return normalized(spark, sf, "spec_src").select(*KEYS, "component_completeness")


@query("component_details", f"{SPEC} SELECT {KEYS_SQL}, category, {joined_sql('details')} AS component_details FROM norm")
def _(spark, sf):
    entries = F.transform(F.map_entries("component_details"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return normalized(spark, sf, "spec_src").select(*KEYS, "category", joined(entries, "component_details"))


@query("listing_status", f"{SPEC} SELECT {KEYS_SQL}, listing_status, status FROM norm")
def _(spark, sf):
    return normalized(spark, sf, "spec_src").select(*KEYS, "listing_status", "status")


@query("cost_fields", f"{SPEC} SELECT {KEYS_SQL}, current_total_cost, cost_per_unit, cost_per_gb, cost_confidence FROM norm")
def _(spark, sf):
    return normalized(spark, sf, "spec_src").select(*KEYS, "current_total_cost", "cost_per_unit", "cost_per_gb", "cost_confidence")


_NORM = ["title", "opportunity_key", "canonical_url", "manufacturer", "model", "quantity", "total_price", "cost_per_unit", "condition",
         "location_state", "listing_status", "needs_manual_review", "pickup_only"]


@query("normalize_hardware", f"{LISTED} SELECT {KEYS_SQL}, {', '.join(_NORM)}, {joined_sql('risk_flags')} AS risk_flags FROM norm")
def _(spark, sf):
    return normalized(spark, sf).select(*KEYS, *_NORM, joined("risk_flags"))


@query("score_hardware", f"{SPEC}, {score_sql()} SELECT {KEYS_SQL}, {_SCORE_COLUMNS}, {joined_sql('score_reasons')} AS score_reasons, {joined_sql('recommendation_reasons')} AS recommendation_reasons FROM scored")
def _(spark, sf):
    scored = hardware.score_hardware(normalized(spark, sf, "spec_src"))
    return scored.select(*KEYS, *_SCORE_COLUMNS.split(", "), joined("score_reasons"), joined("recommendation_reasons"))


_VERIFY = flags([
    ("coalesce(quantity, 0) = 0", "quantity"), ("coalesce(total_price, 0) = 0", "price"), ("location_state IS NULL", "location"),
    ("configuration IS NULL", "configuration"), ("true", "auction end time"), ("listing_status = 'unknown'", "listing status"),
    ("component_completeness = 'unknown'", "component completeness")])


@query("needs_verification_fields", f"{SPEC} SELECT {KEYS_SQL}, {joined_sql(_VERIFY)} AS fields FROM norm")
def _(spark, sf):
    return normalized(spark, sf, "spec_src").select(*KEYS, joined(lifecycle.needs_verification_fields(), "fields"))


# ---------------------------------------------------------------- dedupe and split

@query("first_wins_dedupe", f"""{LISTED}, firsts AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY {TRAIL}) AS rn,
  count(*) OVER (PARTITION BY canonical_url) - 1 AS duplicates FROM canon)
SELECT canonical_url, original_title, {KEYS_SQL}, duplicates FROM firsts WHERE rn = 1""")
def _(spark, sf):
    from dealsift.functions import url
    keyed = hits_of(spark, sf).select(*ORDER, "original_title", url.canonical(F.col("source_url")).alias("canonical_url"))
    return dedupe.first_wins(keyed, ["canonical_url"], ORDER, "duplicates").select("canonical_url", "original_title", *KEYS, "duplicates")


@query("split_outputs", f"""{LISTED}, lanes AS (SELECT *, CASE page_type WHEN 'specific_listing' THEN 'final' WHEN 'listing_collection' THEN 'discovery' WHEN 'source_page' THEN 'discovery' ELSE 'rejected' END AS lane FROM paged),
firsts AS (SELECT *, row_number() OVER (PARTITION BY lane, canonical_url ORDER BY {TRAIL}) AS rn FROM lanes)
SELECT {KEYS_SQL}, amount, canonical_url, CASE WHEN lane = 'rejected' THEN page_type WHEN rn = 1 THEN lane ELSE 'duplicate' END AS disposition FROM firsts""")
def _(spark, sf):
    from dealsift.functions import url
    pages = classify.classify_hardware_pages(hits_of(spark, sf))
    kind = F.col("page_type")
    lane = F.when(kind == "specific_listing", "final").when(kind.isin("listing_collection", "source_page"), "discovery").otherwise("rejected")
    rows = pages.select(*ORDER, "page_type", lane.alias("lane"), url.canonical(F.col("source_url")).alias("canonical_url"))
    flagged = dedupe.mark_first(rows, ["lane", "canonical_url"], ORDER)
    disposition = F.when(F.col("lane") == "rejected", kind).when(F.col("is_first"), F.col("lane")).otherwise("duplicate")
    # one pass: the column tells the outputs apart; a sink partitions by it
    return flagged.select(*KEYS, "amount", "canonical_url", disposition.alias("disposition"))


@query("union_sources", f"""{cte('listing_src', 'spec_src')} SELECT 0 AS source_ord, {KEYS_SQL}, category, source_url FROM listing_src
UNION ALL SELECT 1, {KEYS_SQL}, category, source_url FROM spec_src""".replace("listing_src AS", "WITH listing_src AS", 1))
def _(spark, sf):
    return dedupe.union_sources(record(spark, sf, "listing_src"), record(spark, sf, "spec_src").drop("original_title")).select(
        "source_ord", *KEYS, "category", "source_url")


@query("ordered_distinct", f"""{SPEC}, words AS (SELECT *, string_split(lower(text), ' ') AS w FROM parts)
SELECT {KEYS_SQL}, array_to_string({distinct_list('w')}, ' ') AS words FROM words""")
def _(spark, sf):
    text = F.lower(F.concat("original_title", F.lit(" "), "original_description"))
    return record(spark, sf, "spec_src").select(*KEYS, F.array_join(F.array_distinct(F.split(text, " ")), " ").alias("words"))


# ---------------------------------------------------------------- ranking and views

def scored_unique(spark, sf) -> DataFrame:
    return scans.hardware_scan(hits_of(spark, sf), AS_OF, ORDER).listings


_UNIQUE = f"""{LISTED}, picked AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_key ORDER BY {TRAIL}) AS rn
  FROM norm WHERE page_type = 'specific_listing') WHERE rn = 1), moved AS (SELECT * REPLACE (
    CASE WHEN listing_status = 'unknown' AND observed_at < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 'needs_manual_review' ELSE listing_status END AS listing_status) FROM picked),
{score_sql('moved')}"""
_RANK = f"opportunity_score DESC, risk_score, {TRAIL}"


@query("rank_opportunities", f"{_UNIQUE} SELECT opportunity_key, title, {_SCORE_COLUMNS} FROM scored WHERE listing_status = 'active' ORDER BY {_RANK}")
def _(spark, sf):
    scan = scans.hardware_scan(hits_of(spark, sf), AS_OF, ORDER)
    return hardware.rank_opportunities(scan.current, *ORDER).select("opportunity_key", "title", *_SCORE_COLUMNS.split(", "))


@query("topk_caps", f"""{_UNIQUE}, active AS (SELECT * FROM scored WHERE listing_status = 'active')
SELECT 'current' AS list_name, opportunity_key, opportunity_score FROM (SELECT * FROM active ORDER BY {_RANK} LIMIT 120)
UNION ALL SELECT 'top', opportunity_key, opportunity_score FROM (SELECT * FROM active ORDER BY {_RANK} LIMIT 20)
UNION ALL SELECT 'report', opportunity_key, opportunity_score FROM (SELECT * FROM active ORDER BY {_RANK} LIMIT 8)
UNION ALL SELECT 'history', opportunity_key, opportunity_score FROM (SELECT * FROM scored WHERE dead ORDER BY {TRAIL} LIMIT 80)""")
def _(spark, sf):
    scan = scans.hardware_scan(hits_of(spark, sf), AS_OF, ORDER)
    rows = scan.listings.withColumn("last_seen_at", F.lit(AS_OF).cast("timestamp"))
    lists = funnel.ranked_lists(rows, AS_OF, {"top": 120, "history": 80}, tuple(ORDER))
    # the shorter lists are the head of the long one
    best, place = F.col("list_name") == "top", F.col("position")
    names = F.array_compact(F.array(
        F.when(best, F.lit("current")), F.when(best & (place <= 20), F.lit("top")), F.when(best & (place <= 8), F.lit("report")),
        F.when(~best, F.lit("history"))))
    return lists.select(F.explode(names).alias("list_name"), "opportunity_key", "opportunity_score")


_SORTS = {"price": "coalesce(current_total_cost, -1) DESC", "risk": "risk_score DESC", "score": "opportunity_score DESC"}


@query("view_sort", f"{SPEC}, {score_sql()} " + " UNION ALL ".join(
    f"SELECT '{name}' AS sort_name, {KEYS_SQL}, amount, row_number() OVER (ORDER BY {order}, {TRAIL}) AS position FROM scored" for name, order in _SORTS.items()))
def _(spark, sf):
    scored = hardware.score_hardware(normalized(spark, sf, "spec_src")).select(*ORDER, "current_total_cost", "total_price", "risk_score", "opportunity_score")
    # every order draws its ranges and then deals its rows: score the listings once for all of them
    folder = shared_folder(spark, "scored")
    write_snapshot(scored, folder, 0)
    scored = read_snapshot(spark, folder)
    out = None
    for name in _SORTS:
        part = lifecycle.view_sort(scored, name, *ORDER, position="position").select(F.lit(name).alias("sort_name"), *KEYS, "amount", "position")
        out = part if out is None else out.unionByName(part)
    return out


_VIEW_SQL = {
    "current": "listing_status IN ('active', 'ending_soon') OR (listing_status = 'unknown' AND NOT needs_manual_review)",
    "active": "listing_status = 'active'", "ending_soon": "listing_status = 'ending_soon'",
    "needs_review": "needs_manual_review OR listing_status IN ('unknown', 'needs_manual_review')",
    "expired": f"listing_status IN {in_list(rules.DEAD_STATUSES)}",
    "missing_components": f"component_completeness IN {in_list(rules.INCOMPLETE_VALUES)}", "pickup_only": "pickup_only"}


@query("opportunity_view", f"{SPEC} " + " UNION ALL ".join(
    f"SELECT '{v}' AS view_name, count(*) AS listings, sum(listing_no) AS listing_sum FROM norm WHERE {c}" for v, c in _VIEW_SQL.items()))
def _(spark, sf):
    rows = normalized(spark, sf, "spec_src")
    # one pass: every listing is tagged with the views it belongs to
    views = F.array_compact(F.array(*[F.when(lifecycle.in_view(v), F.lit(v)) for v in lifecycle.VIEWS]))
    tagged = rows.select("listing_no", F.explode(views).alias("view_name")).groupBy("view_name").agg(
        F.count(F.lit(1)).alias("listings"), F.sum("listing_no").alias("listing_sum"))
    every = rows.sparkSession.createDataFrame([(v,) for v in lifecycle.VIEWS], "view_name string")
    return every.join(tagged, "view_name", "left").select("view_name", F.coalesce("listings", F.lit(0)).alias("listings"), "listing_sum")
