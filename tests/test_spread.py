"""Heavy work is dealt to all tasks and done once, however few row groups the tables lie in."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from dealsift.catalog import hardware as H, history, records  # noqa: F401
from dealsift.catalog.registry import QUERIES
from dealsift.operators import funnel, lifecycle, spatial
from dealsift.plans import scans
from dealsift.sources import pages
from dealsift.streaming import flows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _steps(df, text):
    """Steps of the plan that work out something with the text in it."""
    return sum(text in line for line in _plan(df).splitlines())


def _parts(tmp_path, n=50):
    pq.write_table(pa.table({"p_partkey": list(range(n)), "p_name": ["lot"] * n}), tmp_path / "part.parquet")
    return str(tmp_path)


def test_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    folder = _parts(tmp_path)
    read = records.load(spark, folder, "part")
    assert read.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.p_partkey for r in read.collect()) == list(range(50))
    # a filter on a computed column is not moved to the reading task
    plan = _plan(read.withColumn("low", F.lower("p_name")).filter(F.col("low") == "lot"))
    assert plan.index("lower(p_name") < plan.index("Repartition")


def test_large_tables_stay_as_their_files_split_them(spark, tmp_path):
    read = spark.read.parquet(_parts(tmp_path) + "/part.parquet")
    assert records.dealt(read, 1 << 40) is read


def test_pages_are_read_once(spark):
    html = '<div class="item-cell"><a class="item-title" href="/a">Card</a><li class="price-current">$5</li></div>'
    shop = spark.createDataFrame([(1, html), (2, "<p>empty</p>"), (3, None)], "page_id int, html string")
    cards = pages.html_card_scan(shop, "Newegg")
    assert _steps(cards, "item-cell") == 1
    assert [(r.page_id, r.title) for r in cards.collect()] == [(1, "Card")]
    found = pages.html_result_scan(shop)
    assert _steps(found, "result__snippet") == 1
    assert found.count() == 0


def test_lines_are_dealt_before_their_cells(spark):
    vertices = [(30.0, -98.0), (31.5, -95.0)]
    lines = spark.createDataFrame([(1, "transmission_line", 30.7, -96.5, vertices)],
                                  "asset_id int, asset_type string, lat double, lon double, vertices array<struct<lat:double,lon:double>>")
    sites = spark.createDataFrame([(1, 30.75, -96.5), (2, 35.0, -96.5), (3, 30.1, -98.1)], "site_id int, lat double, lon double")
    pairs = spatial.radius_join(sites, lines, 25.0)
    assert "Repartition" in _plan(pairs)
    assert sorted(r.site_id for r in pairs.collect()) == [1, 3]


def test_cells_of_a_box_are_worked_out_once(spark):
    box = spark.createDataFrame([(30.0, 30.1, -179.9, -179.8)], "s double, n double, w double, e double")
    cells = box.select(spatial._covering_cells(F.col("s"), F.col("n"), F.col("w"), F.col("e"), 25.0).alias("c"))
    assert _plan(cells).count("radians") + _plan(cells).count("RADIANS") == 1
    got = {(c.r, c.c) for c in cells.first().c}
    side = spatial._cell_degrees(25.0)
    assert (int(30.05 // side), int(-179.85 // side)) in got
    assert (int(30.05 // side), int(179.9 // side)) in got  # across the date line


def test_views_are_scored_once(spark, monkeypatch):
    seen, sort = [], lifecycle.view_sort

    def watched(listings, *args, **kwargs):
        seen.append(listings.inputFiles())
        return sort(listings, *args, **kwargs)

    monkeypatch.setattr(H.lifecycle, "view_sort", watched)
    QUERIES["view_sort"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and seen[0] == seen[1] == seen[2]
    assert all("/scored-" in f for f in seen[0])


def test_funnel_reads_each_input_once(spark, tmp_path):
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    raw = stored("raw", [("specific_listing",), ("specific_listing",), ("irrelevant",)], "page_type string")
    listings = stored("listings", [("active", False, ["NEW"], 70.0, None, None)],
                      "listing_status string, needs_manual_review boolean, change_types array<string>, opportunity_score double, "
                      "last_status_check_at timestamp, first_seen_at timestamp")
    runs = stored("runs", [("failed",), ("success",)], "status string")
    counted = funnel.hardware_funnel(raw, listings, runs, "2001-06-01 00:00:00")
    assert _plan(counted).count("Relation") == 3
    got = {r.metric: r.value for r in counted.collect()}
    assert (got["normalized_listings"], got["duplicates_removed"], got["failed_sources"], got["high_score_opportunities"]) == (2, 1, 1, 1)
    assert "deduplicated" not in got


def test_scan_carries_only_the_columns_asked_for(spark):
    page = "<html><title>Detail lot</title><p>Current Bid: $640 Closing date: 06/01/2001 11:15 PM EST</p></html>"
    hits = spark.createDataFrame(
        [(i, "Dealer", "https://a.example.com/lot/7/", "Lot of 5 Dell PowerEdge R640 server tested", "Current bid: $10", "servers", 200, page) for i in range(3)],
        "no int, source_name string, source_url string, original_title string, original_description string, category string, http_status int, body string")
    hits = hits.withColumns({"domain": F.lit("a.example.com"), "captured_at": F.lit("2001-06-01 00:00:00").cast("timestamp"),
                             "timed_out": F.lit(False), "error": F.lit(None).cast("string")})
    known = spark.createDataFrame([("other", 1.0)], "opportunity_key string, total_price double")
    narrow = scans.hardware_scan(hits, "2001-06-01 00:00:00", ["no"], known, responses=True, columns=["end_time_utc"]).listings
    whole = scans.hardware_scan(hits, "2001-06-01 00:00:00", ["no"], known, responses=True).listings
    assert "body" in whole.columns and not {"body", "raw_description"} & set(narrow.columns)
    assert narrow.collect() == whole.select(narrow.columns).collect()
    assert [(r.no, r.end_time_utc is None, r.total_price) for r in narrow.collect()] == [(0, False, 640.0)]


def test_dashboard_finds_its_listings_once(spark, monkeypatch, tmp_path):
    n = 6
    pq.write_table(pa.table({"p_partkey": list(range(n)), "p_name": ["lot"] * n, "p_size": [40] * n}), tmp_path / "part.parquet")
    pq.write_table(pa.table({
        "l_orderkey": list(range(n)), "l_linenumber": [1] * n, "l_suppkey": [0] * n, "l_partkey": list(range(n)), "l_quantity": [5.0] * n,
        "l_returnflag": ["A"] * n, "l_extendedprice": [100.0] * n, "l_linestatus": ["O"] * 4 + ["F"] * 2, "l_shipdate": ["1997-01-01"] * n}), tmp_path / "lineitem.parquet")
    seen = []
    for name in ("dashboard_rollup", "dashboard_totals"):
        def watched(listings, *args, kept=getattr(funnel, name), **kwargs):
            seen.append(listings.inputFiles())
            return kept(listings, *args, **kwargs)

        monkeypatch.setattr(funnel, name, watched)
    rows = QUERIES["dashboard_rollup"](spark, str(tmp_path)).collect()
    assert len(seen) == 2 and seen[0] == seen[1]
    assert all("/dashboard-" in f for f in seen[0])
    assert {r.list_name: r.opportunity_key for r in rows if r.list_name.startswith("total_")} == {
        "total_seen": "6", "total_active": "4", "total_history": "2", "total_review": "0"}


def test_saved_searches_find_their_alerts_once(spark):
    changes = spark.createDataFrame(
        [(i, f"Dell PowerEdge lot {'zx' if i % 7 == 0 else 'server'} {i}", "eBay", i % 2 == 0, i % 5 == 0) for i in range(50)],
        "listing_no int, title string, source_name string, price_drop boolean, back_in_stock boolean")
    searches = spark.createDataFrame([(1, "poweredge ZX", []), (2, "dell", ["Other"])], "search_id int, query string, sources array<string>")
    found = flows.saved_search_match(changes, searches)
    assert all("/alerts-" in f or "/searches-" in f for f in found.inputFiles())
    found.collect()
    # the words of the rows are not shuffled to meet a few searches
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    want = [(1, i, a) for i in range(0, 50, 7) for a, on in (("price_drop", i % 2 == 0), ("back_in_stock", i % 5 == 0)) if on]
    assert sorted((r.search_id, r.listing_no, r.alert_type) for r in found.collect()) == sorted(want)


def test_lines_are_measured_by_the_segments_near_a_cell(spark):
    bent = [(30.0 + i * 0.3, -98.0 + (i % 3) * 0.4 + i * 0.05) for i in range(9)]
    crowded = [(32.0 + (i % 2) * 0.05, -97.0 + i * 0.01) for i in range(12)]
    shapes = [(1, bent), (2, crowded), (3, [(31.0, -97.5)]), (4, [(30.0, -99.0), (30.0, -99.0), (30.5, -99.2)])]
    lines = spark.createDataFrame([(i, "transmission_line", v[0][0], v[0][1], v) for i, v in shapes] + [(5, "tower", 30.4, -98.1, None), (6, "transmission_line", 31.2, -97.4, [])],
                                  "asset_id int, asset_type string, lat double, lon double, vertices array<struct<lat:double,lon:double>>")
    sites = spark.range(900).selectExpr("id AS site_id", "29.5 + (id % 30) * 0.11 AS lat", "-99.5 + floor(id / 30) * 0.11 AS lon")
    exact = F.when((F.col("asset_type") == "transmission_line") & (F.size("vertices") > 0), spatial.geo.point_to_polyline_miles(F.col("lat"), F.col("lon"), F.col("vertices"))).otherwise(
        spatial.geo.haversine_miles(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon")))
    brute = sites.crossJoin(lines.withColumnsRenamed({"lat": "a_lat", "lon": "a_lon"})).select("site_id", "asset_id", F.round(exact, 3).alias("d")).filter("d <= 25")
    got = spatial.radius_join(sites, lines, 25.0).select("site_id", "asset_id", "distance_miles")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect()))
    # a cell has the segments that reach it, not the whole line
    reach = spatial._reach(lines.filter("asset_id = 1"), 25.0).select(F.size("_near").alias("n"), "_row", "_col").collect()
    assert len({(r._row, r._col) for r in reach}) == len(reach) and max(r.n for r in reach) < 8
    near = spatial._reach(lines.filter("asset_id = 2"), 25.0).select(F.max(F.size("_near"))).first()[0]
    assert near > spatial._FEW_SEGMENTS  # more than compiled code measures


def test_pairs_of_lines_decide_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_LINE_PAIRS_PER_TASK", 50)
    line = spark.createDataFrame([(1, "transmission_line", 30.0, -98.0, [(30.0, -98.0), (30.2, -98.0)])],
                                 "asset_id int, asset_type string, lat double, lon double, vertices array<struct<lat:double,lon:double>>")
    sites = spark.range(2000).selectExpr("id AS site_id", "30.0 + (id % 40) * 0.005 AS lat", "-98.0 + floor(id / 40) * 0.005 AS lon")
    pairs = spatial.radius_join(sites, line, 25.0)
    assert "hashpartitioning(_row" in pairs._jdf.queryExecution().executedPlan().toString() and ", 40)" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 2000
