"""Supplier queries."""

from pyspark.sql import DataFrame, functions as F

from dealsift import rules
from dealsift.catalog.records import cte, record
from dealsift.catalog.registry import domain_sql, flags, has, joined, joined_sql, label_list, q, query, rx, url_part
from dealsift.functions import url
from dealsift.operators import classify, funnel, lifecycle, suppliers
from dealsift.operators.dedupe import first_wins
from dealsift.plans import scans

_SHORT = f"trim(regexp_replace(regexp_replace(original_title, {q(rules.COMPANY_TAIL_PATTERN)}, '', 'i'), '\\s*\\|.*$', ''))"
_CAPS = ", ".join(f"{has('low', t)} AS {n}" for n, t in rules.SUPPLIER_CAPABILITIES)
_CERTS = ", ".join(f"CASE WHEN NOT contains(low, {q(t)}) THEN 'unknown' WHEN discovery_mode = 'directory_search_discovery' THEN 'directory_discovered' ELSE 'claimed_on_website' END AS {n}" for n, t in rules.SUPPLIER_CERTS)
_ROOT = f"CASE WHEN {url_part('source_url', 1)} <> '' AND {url_part('source_url', 2)} <> '' THEN lower({url_part('source_url', 1)}) || '://' || {url_part('source_url', 2)} ELSE source_url END"
_FLAGS = rules.SUPPLIER_FLAGS
NORM = f"""WITH {cte('supplier_src')}, p0 AS (SELECT * EXCLUDE state, state AS searched, original_title || ' ' || coalesce(original_description, '') AS text, lower(original_title || ' ' || coalesce(original_description, '')) AS low FROM supplier_src),
p1 AS (SELECT *, {_SHORT} AS company_name, {_ROOT} AS website, {domain_sql('source_url')} AS supplier_key, {rx('text', f"{chr(92)}b({'|'.join(rules.SUPPLIER_CITIES)}){chr(92)}b")} AS city,
  CASE WHEN regexp_matches(text, '\\b(Texas|TX)\\b', 'i') THEN 'Texas' ELSE searched END AS state, {rx('text', rules.ZIP_PATTERN, 0)} AS zip_code, {rx('text', rules.PHONE_PATTERN, 0)} AS phone,
  {rx('text', rules.EMAIL_PATTERN, 0)} AS email, {rx('text', rules.SERVICE_AREA_PATTERN, 0)}[1:160] AS service_area, {_CAPS}, {label_list('low', rules.SUPPLIER_EQUIPMENT)} AS equipment_types, {_CERTS},
  CASE WHEN contains(low, 'data center decommission') THEN 'data_center_decommissioning_company' WHEN {has('low', ['itad', 'asset disposition'])} THEN 'itad_company' WHEN contains(low, 'server') AND {has('low', ['wholesale', 'refurb'])} THEN 'used_server_wholesaler'
    WHEN {has('low', ['electronics recycler', 'recycling'])} THEN 'electronics_recycler' WHEN {has('low', ['asset remarketing', 'asset recovery'])} THEN 'asset_remarketing_company' ELSE 'supplier_discovered' END AS company_type FROM p0),
norm AS (SELECT *, CASE WHEN data_center_decommissioning AND (direct_asset_purchasing OR asset_remarketing) THEN 'A' WHEN enterprise_itad OR asset_remarketing OR data_center_decommissioning THEN 'B'
    WHEN server_recycling OR computer_refurbishing OR wholesale OR bulk_sales THEN 'C' ELSE 'D' END AS supplier_category,
  {flags([('true', _FLAGS['always']), (has('low', rules.SUPPLIER_LOW_VALUE_TEXT), _FLAGS['low_value']), ('phone IS NULL AND email IS NULL', _FLAGS['contact']), ('true', _FLAGS['cert'])])} AS quality_flags FROM p1)"""
_CERT_POINTS = " + ".join(f"CASE WHEN {n} <> 'unknown' THEN 3 ELSE 0 END" for n, _ in rules.SUPPLIER_CERTS)
_SCORED = f"""scored AS (SELECT *, cast(least(100, CASE supplier_category WHEN 'A' THEN 25 WHEN 'B' THEN 18 WHEN 'C' THEN 10 ELSE 0 END + CASE WHEN asset_remarketing OR direct_asset_purchasing THEN 20 ELSE 0 END
  + CASE WHEN server_recycling OR list_contains(equipment_types, 'servers') THEN 15 ELSE 0 END + {_CERT_POINTS} + CASE WHEN bulk_sales OR wholesale THEN 10 ELSE 0 END + CASE WHEN data_center_decommissioning THEN 5 ELSE 0 END
  + CASE WHEN phone IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN state IS NOT NULL OR city IS NOT NULL THEN 5 ELSE 0 END) AS double) AS supplier_score,
  list_filter([CASE supplier_category WHEN 'A' THEN 'Likely direct enterprise/data-center asset source' WHEN 'B' THEN 'ITAD/asset disposition capability' WHEN 'C' THEN 'Used enterprise hardware wholesale/refurbishing signal' END,
    CASE WHEN asset_remarketing OR direct_asset_purchasing THEN 'Asset remarketing or direct purchasing signal' END, CASE WHEN server_recycling OR list_contains(equipment_types, 'servers') THEN 'Server/data-center equipment signal' END,
    CASE WHEN {_CERT_POINTS} > 0 THEN 'Certification signal requires verification' END, CASE WHEN bulk_sales OR wholesale THEN 'Bulk sales / wholesale signal' END, CASE WHEN data_center_decommissioning THEN 'Onsite decommissioning signal' END], lambda x: x IS NOT NULL) AS score_reasons FROM norm)"""
_UNIQUE = "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supplier_key ORDER BY hit_no) AS rn FROM {src}) WHERE rn = 1)"


def hits(spark, sf) -> DataFrame:
    return record(spark, sf, "supplier_src")


def normal(spark, sf) -> DataFrame:
    return suppliers.normalize_supplier(hits(spark, sf))


_FIELDS = ["company_name", "company_type", "website", "city", "state", "zip_code", "phone", "email", "service_area", "supplier_category", "supplier_key"]


@query("normalize_supplier", f"{NORM} SELECT hit_no, {', '.join(_FIELDS)}, {joined_sql('equipment_types')} AS equipment_types, {joined_sql('quality_flags')} AS quality_flags FROM norm")
def _(spark, sf):
    return normal(spark, sf).select("hit_no", *_FIELDS, joined("equipment_types"), joined("quality_flags"))


_CAP_NAMES = [n for n, _ in rules.SUPPLIER_CAPABILITIES]


@query("supplier_capabilities", f"{NORM} SELECT hit_no, {', '.join(_CAP_NAMES)} FROM norm")
def _(spark, sf):
    return normal(spark, sf).select("hit_no", *_CAP_NAMES)


@query("supplier_category", f"{NORM} SELECT supplier_category, count(*) AS suppliers FROM norm GROUP BY supplier_category")
def _(spark, sf):
    return normal(spark, sf).groupBy("supplier_category").agg(F.count(F.lit(1)).alias("suppliers"))


_CERT_NAMES = [n for n, _ in rules.SUPPLIER_CERTS]


@query("cert_status", f"{NORM} SELECT hit_no, {', '.join(_CERT_NAMES)} FROM norm")
def _(spark, sf):
    return normal(spark, sf).select("hit_no", *_CERT_NAMES)


@query("company_fields", f"{NORM} SELECT hit_no, company_name, website, company_type FROM norm")
def _(spark, sf):
    return normal(spark, sf).select("hit_no", "company_name", "website", "company_type")


_HAY = f"lower(original_title || ' ' || original_description || ' ' || {domain_sql('source_url')})"


@query("supplier_relevance", f"{NORM} SELECT hit_no, source_url FROM norm WHERE NOT {has(_HAY, rules.SUPPLIER_BLOCKED)} AND NOT {has(_HAY, rules.SUPPLIER_LOW_VALUE_HITS)} AND {has(_HAY, rules.SUPPLIER_WANTED)}")
def _(spark, sf):
    return classify.supplier_relevance(hits(spark, sf).withColumn("domain", url.domain(F.col("source_url")))).select("hit_no", "source_url")


@query("reject_low_value", f"{NORM}, {_UNIQUE.format(src='norm')} SELECT supplier_key, supplier_category = 'D' AS rejected FROM uniq")
def _(spark, sf):
    unique = first_wins(normal(spark, sf), ["supplier_key"], ["hit_no"])
    kept, rejected = suppliers.reject_low_value(unique)
    return kept.select("supplier_key", F.lit(False).alias("rejected")).unionByName(rejected.select("supplier_key", F.lit(True).alias("rejected")))


@query("score_supplier", f"{NORM}, {_SCORED} SELECT hit_no, supplier_score, {joined_sql('score_reasons')} AS score_reasons FROM scored")
def _(spark, sf):
    return suppliers.score_supplier(normal(spark, sf)).select("hit_no", "supplier_score", joined("score_reasons"))


@query("supplier_funnel", f"""{NORM}, {_UNIQUE.format(src='norm')} SELECT (SELECT count(*) FROM norm) AS raw_results, (SELECT count(*) FROM norm) AS normalized_suppliers, (SELECT count(*) FROM norm) - count(*) AS duplicates_removed,
  count(*) FILTER (supplier_category = 'D') AS low_value_filtered, count(*) FILTER (supplier_category <> 'D') AS final_suppliers, count(*) FILTER (supplier_category IN ('A', 'B')) AS high_value_suppliers FROM uniq""")
def _(spark, sf):
    return funnel.supplier_funnel(normal(spark, sf))


@query("supplier_view", f"{NORM}, {_SCORED} SELECT hit_no, city FROM scored WHERE supplier_category = 'B' AND contains(lower(coalesce(city, '') || ' ' || coalesce(state, '')), 'texas') AND contains(lower(company_type || ' ' || array_to_string(equipment_types, ' ') || ' ' || array_to_string(score_reasons, ' ') || ' ' || array_to_string(quality_flags, ' ')), 'certification')")
def _(spark, sf):
    return lifecycle.supplier_view(suppliers.score_supplier(normal(spark, sf)), "B", "texas", "certification").select("hit_no", "city")


@query("supplier_search", f"{NORM}, {_SCORED}, {_UNIQUE.format(src='scored')} SELECT supplier_key, company_name, supplier_category, supplier_score FROM uniq WHERE supplier_category <> 'D'")
def _(spark, sf):
    return scans.supplier_search(hits(spark, sf), ["hit_no"]).select("supplier_key", "company_name", "supplier_category", "supplier_score")
