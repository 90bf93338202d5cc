"""Views over the given tables with the record shapes of the operators.

The statements run unchanged on Spark and as CTEs of the comparison SQL.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealsift.functions.fence import keep_rows

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

RECORDS = {
    "listing_src": """
SELECT l.l_orderkey * 100 + l.l_linenumber AS listing_no,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'GovDeals' WHEN 1 THEN 'Public Surplus' WHEN 2 THEN 'eBay' ELSE 'HGP Industrial Auctions' END AS source_name,
  CASE l.l_suppkey % 4
    WHEN 0 THEN concat('https://www.govdeals.com/en/asset/', cast(l.l_orderkey AS varchar(20)), '?utm_source=feed')
    WHEN 1 THEN concat('https://www.publicsurplus.com/sms/auction/view?auc=', cast(l.l_orderkey AS varchar(20)), '&x=', cast(l.l_linenumber AS varchar(20)))
    WHEN 2 THEN concat('https://ebay.com/itm/', replace(p.p_name, ' ', '-'), '/', cast(10000000000 + l.l_orderkey AS varchar(20)))
    ELSE CASE l.l_linenumber
      WHEN 1 THEN concat('http://hgpauction.com/search?q=', replace(p.p_name, ' ', '+'))
      WHEN 2 THEN concat('http://hgpauction.com/news/', cast(l.l_orderkey AS varchar(20)))
      WHEN 3 THEN 'http://hgpauction.com/about/'
      WHEN 4 THEN concat('https://www.reddit.com/r/lots/', cast(l.l_orderkey AS varchar(20)))
      ELSE concat('http://hgpauction.com/lot/', cast(l.l_orderkey AS varchar(20)), '/') END END AS source_url,
  concat('Lot of ', cast(cast(l.l_quantity AS int) AS varchar(20)), ' Dell PowerEdge R', cast(600 + p.p_size AS varchar(20)), ' server ',
    CASE l.l_returnflag WHEN 'A' THEN 'tested' WHEN 'R' THEN 'untested for parts' ELSE 'refurbished' END) AS original_title,
  concat('Current bid: $', cast(cast(floor(l.l_extendedprice) AS bigint) AS varchar(20)), ' located in ',
    CASE l.l_partkey % 3 WHEN 0 THEN 'Texas' WHEN 1 THEN 'OH' ELSE 'nowhere' END,
    CASE l.l_linestatus WHEN 'F' THEN ' auction ended' ELSE ' pickup only' END) AS original_description,
  CASE l.l_partkey % 5 WHEN 0 THEN 'servers' WHEN 1 THEN 'gpu' WHEN 2 THEN 'memory' WHEN 3 THEN 'storage' ELSE 'cpu' END AS category,
  cast(l.l_shipdate AS timestamp) AS observed_at, l.l_partkey AS part_no, l.l_suppkey AS supp_no, l.l_extendedprice AS amount
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    # every category's own vocabulary, so that each attribute rule is reached
    "spec_src": """
SELECT l.l_orderkey * 100 + l.l_linenumber AS listing_no, cast(l.l_shipdate AS timestamp) AS observed_at,
  l.l_partkey AS part_no, l.l_suppkey AS supp_no, l.l_extendedprice AS amount,
  CASE l.l_partkey % 5 WHEN 0 THEN 'servers' WHEN 1 THEN 'gpu' WHEN 2 THEN 'memory' WHEN 3 THEN 'storage' ELSE 'cpu' END AS category,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'GovDeals' WHEN 1 THEN 'Auction House' ELSE 'Dealer' END AS source_name,
  concat('https://site', cast(l.l_suppkey % 7 AS varchar(20)), '.example.com/lot/', cast(l.l_orderkey AS varchar(20))) AS source_url,
  concat(CASE l.l_partkey % 5
      WHEN 0 THEN concat('HP ProLiant DL', cast(300 + p.p_size AS varchar(20)), ' dual CPU 2x Intel Xeon Gold 6130 ', cast(32 * (1 + p.p_size % 8) AS varchar(20)), ' GB RAM 4 TB SAS drives 2 power supplies')
      WHEN 1 THEN concat('NVIDIA A100 GPU ', cast(40 + p.p_size AS varchar(20)), ' GB HBM2e working')
      WHEN 2 THEN concat(cast(8 * (1 + p.p_size % 8) AS varchar(20)), ' GB DDR4 ECC RDIMM 3200 MT/s server memory Part Number: M393A', cast(1000 + p.p_size AS varchar(20)))
      WHEN 3 THEN concat('Samsung ', cast(960 + p.p_size AS varchar(20)), ' GB NVMe SSD U.2 tray included wiped')
      ELSE concat('AMD EPYC ', cast(7000 + p.p_size AS varchar(20)), ' socket SP3 matched pair Gen 3') END,
    CASE l.l_linenumber WHEN 1 THEN ' no hard drive' WHEN 2 THEN ' no cpu barebone' WHEN 3 THEN ' mixed lot pallet' WHEN 4 THEN ' not working' WHEN 5 THEN ' complete system' WHEN 6 THEN ' no power supply' ELSE ' used working' END) AS original_title,
  concat('qty ', cast(cast(l.l_quantity AS int) AS varchar(20)),
    CASE l.l_returnflag WHEN 'A' THEN concat(' Buyer''s premium: ', cast(5 + l.l_linenumber AS varchar(20)), '% shipping available') WHEN 'R' THEN ' no shipping local pickup' ELSE ' ITAD asset disposition' END,
    CASE l.l_linestatus WHEN 'F' THEN concat(' $', cast(1 + l.l_linenumber AS varchar(20)), ',', cast(100 + p.p_size AS varchar(20)), '.50 buy it now') ELSE ' closed' END) AS original_description
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "observation": """
SELECT event_id, concat(cast(user_id AS varchar(20)), '|', event_type) AS opportunity_key, cast(ts AS timestamp) AS observed_at,
  cast(floor(value / 50) AS bigint) * 50 AS total_price_usd,
  cast(event_id % 3 AS int) AS quantity,
  CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'ending_soon' ELSE 'ended' END AS listing_status
FROM {events}""",
    # listings in every status, with and without an end time
    "tracked": """
SELECT event_id, concat(cast(user_id AS varchar(20)), '|', event_type) AS opportunity_key, cast(ts AS timestamp) AS observed_at,
  cast(floor(value / 50) AS bigint) * 50 AS total_price_usd, cast(event_id % 3 AS int) AS quantity,
  CASE event_id % 9 WHEN 0 THEN 'active' WHEN 1 THEN 'ending_soon' WHEN 2 THEN 'ended' WHEN 3 THEN 'sold' WHEN 4 THEN 'removed'
    WHEN 5 THEN 'unavailable' WHEN 6 THEN 'needs_manual_review' ELSE 'unknown' END AS listing_status,
  CASE WHEN event_id % 4 < 2 THEN cast(ts AS timestamp) + INTERVAL '1' HOUR * cast(event_id % 400 AS int) END AS end_time_utc,
  CASE WHEN event_id % 5 < 4 THEN cast(ts AS timestamp) END AS last_status_check_at, cast(ts AS timestamp) AS first_seen_at,
  event_id % 11 = 0 AS needs_manual_review, event_id % 5 AS status_check_attempts
FROM {events}""",
    "site": """
SELECT c.c_custkey AS site_id, n.n_name AS state, c.c_acctbal AS asking_price_usd,
  cast(25.0 AS double) + cast(c.c_custkey * 7919 % 24000 AS double) / cast(1000 AS double) AS lat,
  cast(-70.0 AS double) - cast(c.c_custkey * 14729 % 50000 AS double) / cast(1000 AS double) AS lon
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "asset": """
SELECT s_suppkey AS asset_id, CASE s_suppkey % 3 WHEN 0 THEN 'substation' WHEN 1 THEN 'plant' ELSE 'tower' END AS asset_type,
  cast(CASE s_suppkey % 4 WHEN 0 THEN 115 WHEN 1 THEN 138 WHEN 2 THEN 345 END AS double) AS voltage_kv,
  cast(25.0 AS double) + cast(s_suppkey * 6007 % 24000 AS double) / cast(1000 AS double) AS lat,
  cast(-70.0 AS double) - cast(s_suppkey * 31337 % 50000 AS double) / cast(1000 AS double) AS lon
FROM {supplier}""",
    "line_vertex": """
SELECT s_suppkey AS line_id, 0 AS seq,
  cast(25.0 AS double) + cast((s_suppkey * 6007 + 0 * 400) % 24000 AS double) / cast(1000 AS double) AS lat,
  cast(-70.0 AS double) - cast((s_suppkey * 31337 + 0 * 0 * 150) % 50000 AS double) / cast(1000 AS double) AS lon
FROM {supplier}
UNION ALL
SELECT s_suppkey AS line_id, 1 AS seq,
  cast(25.0 AS double) + cast((s_suppkey * 6007 + 1 * 400) % 24000 AS double) / cast(1000 AS double) AS lat,
  cast(-70.0 AS double) - cast((s_suppkey * 31337 + 1 * 1 * 150) % 50000 AS double) / cast(1000 AS double) AS lon
FROM {supplier}
UNION ALL
SELECT s_suppkey AS line_id, 2 AS seq,
  cast(25.0 AS double) + cast((s_suppkey * 6007 + 2 * 400) % 24000 AS double) / cast(1000 AS double) AS lat,
  cast(-70.0 AS double) - cast((s_suppkey * 31337 + 2 * 2 * 150) % 50000 AS double) / cast(1000 AS double) AS lon
FROM {supplier}""",
    "source_run": """
SELECT event_id AS run_id, event_type AS source_name, cast(ts AS timestamp) AS completed_at,
  concat('query ', cast(user_id % 20 AS varchar(20))) AS query,
  CASE WHEN value < 25 THEN 'failed' WHEN value < 40 THEN 'timeout' ELSE 'success' END AS status,
  cast(floor(value) AS bigint) % 7 AS result_count
FROM {events}""",
    "retail_result": """
SELECT p_partkey AS result_id, p_brand AS job_id, p_retailprice AS price, p_size AS distance,
  CASE p_size % 3 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Check Site' ELSE 'Out of Stock' END AS inventory_status,
  p_type = 'PROMO' AS promotion, p_size % 2 = 0 AS pickup_available, p_size % 5 <> 0 AS shipping_available,
  CASE p_partkey % 6 WHEN 0 THEN 'cdw' WHEN 1 THEN 'newegg' WHEN 2 THEN 'best_buy' WHEN 3 THEN 'provantage' WHEN 4 THEN 'micro_center' ELSE 'other' END AS source_key
FROM {part}""",
    "manual_review": """
SELECT o_orderkey AS review_id, o_custkey AS item_id, cast(o_orderdate AS timestamp) AS verified_at,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'ended' ELSE 'needs_manual_review' END AS manual_status
FROM {orders}""",
    "criteria": """
SELECT n_nationkey AS criteria_id, n_name AS state, 1000 + n_nationkey * 200 AS max_price_usd FROM {nation}""",
    "site_src": """
SELECT o_orderkey AS hit_no, cast(o_orderdate AS timestamp) AS fetched_at, o_custkey % 25 AS job_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'Public Web Search' WHEN 1 THEN 'Crexi' ELSE 'Manual Import' END AS source_name,
  CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE concat('Region ', cast(o_custkey % 9 AS varchar(20))) END AS region_name,
  CASE o_orderkey % 5
    WHEN 0 THEN concat('https://www.crexi.com/properties/', cast(o_orderkey % 2000 AS varchar(20)), '/land')
    WHEN 1 THEN concat('https://landsearch.com/industrial/', cast(o_custkey AS varchar(20)))
    WHEN 2 THEN concat('https://broker', cast(o_custkey % 40 AS varchar(20)), '.example.com/property/', cast(o_orderkey % 3000 AS varchar(20)), '?ref=a')
    WHEN 3 THEN concat('https://county', cast(o_custkey % 60 AS varchar(20)), '.example.gov/')
    ELSE 'https://www.reddit.com/r/land' END AS source_url,
  CASE o_orderkey % 4
    WHEN 0 THEN concat(cast(100 + o_custkey % 900 AS varchar(20)), ' County Road ', cast(o_custkey % 90 + 1 AS varchar(20)), ' Abilene, TX 79601')
    WHEN 1 THEN CASE o_custkey % 3 WHEN 0 THEN 'Former factory near Macon, Georgia' WHEN 1 THEN concat(cast(10 + o_custkey % 80 AS varchar(20)), ' Main Street Jackson, GA 30233') ELSE concat(cast(200 + o_custkey % 80 AS varchar(20)), ' US Hwy 290 Fredericksburg TX 78624') END
    WHEN 2 THEN 'Browse industrial properties for sale'
    ELSE 'Economic development available sites' END AS original_title,
  concat('Industrial land ', cast(5 + o_orderkey % 60 AS varchar(20)), ' acres ',
    CASE o_orderkey % 3 WHEN 0 THEN concat('$', cast(1 + o_orderkey % 9 AS varchar(20)), ',', cast(100 + o_custkey % 900 AS varchar(20)), ',000')
      WHEN 1 THEN 'call for price' ELSE concat('$', cast(1 + o_orderkey % 20 AS varchar(20)), ' million') END,
    ' warehouse ', cast(10 + o_custkey % 80 AS varchar(20)), ',000 sqft',
    CASE o_orderkey % 7 WHEN 3 THEN ' Listed By Acme Realty Contact us' ELSE '' END) AS original_description
FROM {orders}""",
    # searches of the site hits: one per nation key, half of them with a size or a state
    "site_criteria": """
SELECT n_nationkey AS job_id,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Texas' WHEN n_nationkey % 3 = 1 THEN 'Georgia' END AS target_state,
  cast(CASE WHEN n_nationkey % 2 = 0 THEN 20 END AS double) AS min_land_acres,
  cast(CASE WHEN n_nationkey % 5 < 3 THEN 5000000 END AS double) AS max_price_usd
FROM {nation}""",
    "supplier_src": """
SELECT p_partkey AS hit_no, CASE p_partkey % 2 WHEN 0 THEN 'public_web_search' ELSE 'directory_search_discovery' END AS discovery_mode,
  CASE p_partkey % 3 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Ohio' END AS state,
  concat('https://www.', replace(p_name, ' ', '-'), cast(p_size AS varchar(20)), '.example.com/about?x=', cast(p_partkey AS varchar(20))) AS source_url,
  concat(p_name, ' co | Home') AS original_title, 'Public Web Search' AS source_name,
  CASE p_partkey % 7
    WHEN 0 THEN 'Data center decommissioning and asset remarketing, we buy servers. Call (214) 555-0101'
    WHEN 1 THEN 'R2 and e-Stewards certified IT asset disposition, Dallas Texas 75201'
    WHEN 2 THEN 'Wholesale refurbished laptops, bulk pallets, sales@example.com'
    WHEN 3 THEN 'Phone repair and consumer drop-off'
    WHEN 4 THEN 'Server recycling serving Houston and Austin'
    WHEN 5 THEN 'NAID AAA electronics recycler, equipment buyer'
    ELSE 'Office furniture' END AS original_description
FROM {part}""",
    # requirement texts in both languages
    "request": """
SELECT o_orderkey AS request_id,
  concat(CASE o_orderkey % 8 WHEN 0 THEN 'TX，' WHEN 1 THEN '帮我搜索德州和乔治亚州' WHEN 2 THEN 'Find sites in Ohio or West Virginia, ' WHEN 3 THEN '29.762731, -98.720308 周边' WHEN 4 THEN 'near ZIP 78624 within ' WHEN 5 THEN 'Harris County IN ' WHEN 6 THEN 'anywhere with rail, ' ELSE 'around 78624 or 75201, ' END,
    CASE o_orderkey % 8 WHEN 3 THEN concat(cast(5 + o_custkey % 30 AS varchar(20)), '英里内，') WHEN 4 THEN concat(cast(5 + o_custkey % 30 AS varchar(20)), ' miles, ') ELSE '' END,
    CASE o_custkey % 4 WHEN 0 THEN concat(cast(10 + o_custkey % 50 AS varchar(20)), '英亩以上的旧制造工厂或工业土地，') WHEN 1 THEN concat(cast(100 + o_custkey % 50 AS varchar(20)), '亩仓库，') WHEN 2 THEN concat(cast(20 + o_custkey % 9 AS varchar(20)), '+ acres industrial land for lease, ') ELSE concat(cast(30 + o_custkey % 9 AS varchar(20)), ',000 sqft warehouse or distribution for sale ') END,
    CASE o_orderkey % 5 WHEN 0 THEN concat('预算', cast(500 + o_custkey % 900 AS varchar(20)), '万美元以内，') WHEN 1 THEN concat('under ', cast(1 + o_custkey % 20 AS varchar(20)), ' million, ') WHEN 2 THEN concat('up to $', cast(1 + o_custkey % 9 AS varchar(20)), ',500,000 ') ELSE '' END,
    CASE o_orderkey % 3 WHEN 0 THEN concat('用于未来建设', cast(10 + o_custkey % 90 AS varchar(20)), 'MW AI数据中心。') WHEN 1 THEN 'near substation 138kV BTC' ELSE '储能' END) AS request_text
FROM {orders}""",
    "supplier_request": """
SELECT c_custkey AS request_id,
  concat(CASE c_custkey % 3 WHEN 0 THEN 'TX，' WHEN 1 THEN '加州 ' ELSE 'anywhere 90210 ' END,
    CASE c_custkey % 4 WHEN 0 THEN '寻找做数据中心退役、企业ITAD、二手服务器、内存、硬盘、笔记本和台式机批量销售的一手供应商。' WHEN 1 THEN 'R2 certified electronics recycler, laptop liquidation' WHEN 2 THEN 'wholesale used server with NAID AAA, switches' ELSE 'equipment buyer for desktops and e-Stewards' END) AS request_text
FROM {customer}""",
    # dated auction texts for the time signals
    "auction_text": """
SELECT o_orderkey AS page_id, timestamp '2026-06-01 12:00:00' AS captured_at,
  CASE WHEN o_custkey % 11 = 0 THEN 'captcha wall' END AS unavailable_reason,
  concat('https://www.publicsurplus.com/sms/auction/view?auc=', cast(o_orderkey AS varchar(20))) AS source_url,
  CASE o_orderkey % 9
    WHEN 0 THEN concat('Auction ends: June ', cast(1 + o_custkey % 28 AS varchar(20)), ', 2026 5:30 PM PDT Current Price: $', cast(100 + o_custkey AS varchar(20)))
    WHEN 1 THEN concat('Closing date 06/0', cast(1 + o_custkey % 9 AS varchar(20)), '/2026 11:15 AM EST High Bid $1,', cast(100 + o_custkey % 900 AS varchar(20)), '.50')
    WHEN 2 THEN concat('Time Left: ', cast(o_custkey % 4 AS varchar(20)), ' d ', cast(1 + o_custkey % 20 AS varchar(20)), ' h 5 m # of Bids ', cast(o_custkey % 30 AS varchar(20)))
    WHEN 3 THEN 'This item sold for $500 yesterday'
    WHEN 4 THEN 'Listing no longer available'
    WHEN 5 THEN 'Bidding closed. Final Price $75'
    WHEN 6 THEN concat('Auction #', cast(o_orderkey AS varchar(20)), ' - Dell servers Auction Ended Jun ', cast(1 + o_custkey % 28 AS varchar(20)), ', 2026 9:05 AM CST Pick-up Location: [ 12 Main St  Austin, TX 78701 ] Description: rack lot local pickup View City of Austin Auctions')
    WHEN 7 THEN concat('(Jul ', cast(1 + o_custkey % 28 AS varchar(20)), ', 2026 1:00 PM XYZ) Shipping options: freight')
    ELSE 'nothing about time' END AS text
FROM {orders}""",
    # captured responses of detail pages
    "http_response": """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 404 WHEN event_id % 7 = 1 THEN 503 WHEN event_id % 7 < 5 THEN 200 END AS http_status,
  CASE WHEN event_id % 7 = 2 THEN 'please solve the CAPTCHA' WHEN event_id % 7 < 5 THEN concat('<p>lot ', cast(user_id AS varchar(20)), '</p>') END AS body,
  event_id % 7 = 5 AS timed_out, CASE WHEN event_id % 7 = 6 THEN concat('connect error ', event_type) END AS error
FROM {events}""",
}

# the listings with the captured response of their page: every failure, every site, every kind of time signal
RECORDS["captured_src"] = """
SELECT s.listing_no, s.source_name, s.source_url, s.original_title, s.category, s.observed_at, s.part_no, s.supp_no, s.amount,
  CASE WHEN s.part_no % 13 = 5 THEN NULL ELSE concat(s.original_description, CASE s.part_no % 10 WHEN 0 THEN ' Ends in 5 h' WHEN 1 THEN ' Closing date: June 9, 2001 4:15 PM MDT' ELSE '' END) END AS original_description,
  timestamp '2001-06-01 00:00:00' AS captured_at, (s.supp_no + s.part_no) % 12 = 3 AS timed_out,
  CASE (s.supp_no + s.part_no) % 12 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 200 END AS http_status,
  CASE WHEN (s.supp_no + s.part_no) % 12 = 4 THEN concat('connect error ', cast(s.listing_no AS varchar(20))) END AS error,
  CASE (s.supp_no + s.part_no) % 12 WHEN 0 THEN NULL WHEN 1 THEN 'down' WHEN 2 THEN '<p>Robot check</p>' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL
    ELSE concat('<html><head><title>', CASE s.part_no % 4 WHEN 0 THEN '' ELSE concat('Detail lot ', cast(s.listing_no AS varchar(20))) END, '</title><script>',
      CASE s.supp_no % 3 WHEN 0 THEN 'var endTime = "Auction ends: June 2, 2001 5:30 PM CDT";' WHEN 1 THEN 'tracking();' ELSE '' END, '</script></head><body><p>',
      CASE s.part_no % 7
        WHEN 0 THEN 'Auction #123 - Dell PowerEdge rack Pick-up Location: [ 12 Main St  Austin, TX 78701 ] # of Bids 7 Current Price: $1,250.00 Time Left: 2 d 3 h 5 m Description: rack lot local pickup View City of Austin Auctions'
        WHEN 1 THEN 'Current Bid: $640 Closing date: 06/01/2001 11:15 PM EST Shipping options: freight'
        WHEN 2 THEN 'Auction #77 - HP lot Auction Ended May 28, 2001 9:05 AM CST Final Price: $75 Minimum bid $10'
        WHEN 3 THEN 'Price: $99.50 &amp; up, 4 pcs. The item sold for parts' WHEN 4 THEN 'Listing no longer available'
        WHEN 5 THEN 'Time Left: 3 h 10 m High Bid $2,000 buyer must pickup (May 31, 2001 1:00 PM XYZ)' ELSE 'nothing about time' END, '</p></body></html>') END AS body
FROM (""" + RECORDS["listing_src"] + ") s"


# tables whose rows carry the text work
_FACTS = {"lineitem", "orders", "events", "pages", "documents", "part", "customer", "supplier"}

#: tables up to this size may lie in few row groups, larger ones are split well enough by their files
_FEW_GROUPS_BYTES = 256 << 20


def _stored_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def dealt(df: DataFrame, stored_bytes: int) -> DataFrame:
    """Rows of a small table dealt to all tasks; a larger one stays as its files split it.

    Filters on computed columns stay behind the deal, or the few reading tasks would compute them.
    """
    if stored_bytes > _FEW_GROUPS_BYTES:
        return df
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keep_rows(df.repartition(tasks), F.lit(True))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.

    A file may hold one row group, which Spark reads in one task, so the rows of small fact tables are dealt to all tasks
    after reading.  The setting ``dealsift.spread`` deals fact tables to that many tasks, whatever their size; it is
    unset unless a session sets it.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in _FACTS:
        return df
    spread = spark.conf.get("dealsift.spread", None)
    return df.repartition(int(spread)) if spread else dealt(df, _stored_bytes(spark, path))


def record(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A record view over the given tables."""
    sql = RECORDS[name]
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def cte(*names: str) -> str:
    """The record views as CTEs for the comparison SQL."""
    return ",\n".join(
        f"{n} AS ({RECORDS[n].format(**{t: t for t in TABLES})})" for n in names)
