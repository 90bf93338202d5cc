"""Batching of streams, places in an order, details by route and the choice of queries inside the row."""

import datetime as dt

from pyspark.sql import functions as F

from dealsift.functions import times
from dealsift.operators import funnel, requests as R, snapshot
from dealsift.operators.positions import with_position
from dealsift.plans import scans
from dealsift.session import STATE_STORE
from dealsift.sources.details import with_details
from dealsift.streaming import changes, flows


def _observations(spark, n=400):
    start = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"k{i % 17}", i, start + dt.timedelta(hours=i), None if i % 11 == 0 else i // 7 % 3 * 50, i // 5 % 2, "active" if i // 9 % 2 else "ended") for i in range(n)]
    return rows, spark.createDataFrame(rows, "opportunity_key string, event_id long, observed_at timestamp, total_price_usd long, quantity int, listing_status string")


def test_changes_do_not_depend_on_batches(spark, tmp_path):
    rows, frame = _observations(spark)
    last, expected = {}, set()
    for key, event, _, *now in rows:
        kinds = [k for k, a, b in zip(("PRICE_CHANGED", "QUANTITY_CHANGED", "STATUS_CHANGED"), now, last.get(key, now)) if a != b]
        if key not in last or kinds:
            expected.add((event, "|".join(kinds) if key in last else "NEW"))
        last[key] = now
    for parts in (1, 7):
        root = f"{tmp_path}/{parts}"
        handle = changes.stream_change_detection(f"{root}/state", f"{root}/changes")
        for k in range(parts):
            batch = frame.filter((F.col("event_id") * parts / len(rows)).cast("int") == k)
            handle(batch, k)
            handle(batch, k)  # a repeated batch leaves the same tables
        found = spark.read.parquet(f"{root}/changes").select("event_id", F.array_join("change_types", "|")).collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_moves_do_not_depend_on_batches(spark, tmp_path):
    start, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    rows = [("hot" if i % 3 else f"k{i % 17}", i, start + i * hour, ("active", "unknown", "ending_soon", "sold")[i % 4], start + (i + i * 37 % 90 - 10) * hour if i % 5 else None) for i in range(400)]
    mark, expected, after = start + 398 * hour, [], {}
    for key, _, seen, status, end in reversed(rows):
        due = []
        if end and status != "sold":
            due = [(end - 24 * hour, "ending_soon")] * (status != "ending_soon") + [(end, "ended")]
        elif status == "unknown":
            due = [(seen + 48 * hour, "needs_manual_review")]
        expected += [(key, at, to) for at, to in due if max(at, seen) <= mark and (key not in after or max(at, seen) < after[key])]
        after[key] = seen
    frame = spark.createDataFrame(rows, "opportunity_key string, event_id long, observed_at timestamp, listing_status string, end_time_utc timestamp")
    for parts in (1, 6):
        root = f"{tmp_path}/{parts}"
        handle = changes.stream_status_aging(f"{root}/state", f"{root}/moves")
        for k in range(parts):
            batch = frame.filter((F.col("event_id") * parts / len(rows)).cast("int") == k)
            handle(batch, k)
            handle(batch, k)
        found = spark.read.parquet(f"{root}/moves").select("opportunity_key", "moved_at", "listing_status").collect()
        assert sorted(map(tuple, found)) == sorted(expected)


def test_positions_are_row_numbers(spark):
    rows = [(i * 7919 % 1000 if i % 3 else 5, i) for i in range(3000)]
    placed = with_position(spark.createDataFrame(rows, "score int, id int"), [F.desc("score"), F.asc("id")], parts=7).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == [i for _, i in sorted(rows, key=lambda r: (-r[0], r[1]))]
    assert sorted(r.position for r in placed) == list(range(1, 3001))
    assert with_position(spark.createDataFrame([], "score int"), [F.asc("score")]).count() == 0


def test_saved_search_joins_on_its_rarest_word(spark):
    rows = spark.createDataFrame([(i, f"Dell PowerEdge lot {'zx' if i == 7 else 'server'} {i}", "eBay") for i in range(50)], "listing_no int, title string, source_name string")
    searches = spark.createDataFrame([(1, "poweredge ZX", []), (2, "dell missingword", []), (3, "dell 7", ["Other"]), (4, " ", [])], "search_id int, query string, sources array<string>")
    counts = {r.word: r.n for r in flows.word_counts(rows, searches).collect()}
    assert counts == {"poweredge": 50, "zx": 1, "dell": 50, "missingword": 0, "7": 1}
    assert [(r.search_id, r.listing_no) for r in flows.match_saved_searches(rows, searches).collect()] == [(1, 7)]


def test_details_take_the_route_of_their_site(spark):
    seen = "2026-06-01 12:00:00"
    page = "<html><head><title>Lot 5</title></head><body>{}</body></html>".format
    rows = [
        (1, "https://www.publicsurplus.com/view?auc=9", "old", None, 200, page("Auction #9 - Rack lot # of Bids 4 Current Price: $70 Time Left: 5 h Description: racks"), None, None),
        (2, "https://shop.example.com/lot/1", "old", "kept", 200, page("Current Bid: $64.50 Closing date: 06/09/2026 4:15 PM MDT"), None, None),
        (3, "https://www.govdeals.com/asset/1", "Home", "Ends in 3 h", 200, page("Time Left: 9 d"), None, None),
        (4, "https://shop.example.com/lot/2", "Lot", "item sold", 404, None, None, None),
        (5, "https://shop.example.com/lot/3", "Lot", "nothing", None, None, True, None),
        (6, "https://shop.example.com/lot/4", "Lot", "nothing", 200, "verify you are human", False, None),
        (7, "https://shop.example.com/lot/5", "Lot", "nothing", None, None, None, "reset"),
        (8, "https://shop.example.com/lot/6", "Lot", "nothing", None, None, None, None)]
    schema = "id int, source_url string, original_title string, original_description string, http_status int, body string, timed_out boolean, error string"
    hits = spark.createDataFrame(rows, schema).withColumns({"captured_at": times.as_timestamp(seen), "title": F.lit("own"), "description": F.lit(1)})
    got = {r.id: r for r in with_details(hits).collect()}
    d = {i: r.detail for i, r in got.items()}
    assert (d[1].title, d[1].bid_count, d[1].total_price, d[1].listing_status, d[1].calculation_confidence) == ("Rack lot", 4, 70.0, "ending_soon", "medium")
    assert (d[2].title, d[2].current_price, d[2].end_time_verification, d[2].end_time_utc) == ("Lot 5", 64.5, "source_confirmed", dt.datetime(2026, 6, 9, 22, 15))
    assert (d[3].title, d[3].listing_status, d[3].end_time_verification, d[3].needs_manual_review) == (None, "ending_soon", "secondary_source_confirmed", False)
    assert (d[4].listing_status, d[4].unavailable_reason, got[4].detail_parse_status) == ("sold", "HTTP 404", "http_unavailable")
    assert (d[5].listing_status, d[5].needs_manual_review, got[5].detail_parse_status) == ("needs_manual_review", True, "timeout")
    assert (d[6].listing_status, d[6].needs_manual_review) == ("unknown", True) and d[7].unavailable_reason == "reset" and d[8] is None
    assert (got[2].original_description, got[1].original_title, got[3].original_title, got[1].title, got[1].description) == ("kept", "Rack lot", "Home", "own", 1)
    assert got[1].source_listing_id == "9" and got[8].detail_checked_at is None and got[1].detail_checked_at == dt.datetime(2026, 6, 1, 12)


def test_round_robin_takes_sources_in_turn(spark):
    asked = spark.createDataFrame([(1, ["tx", "oh"]), (2, [])], "id int, state_names array<string>")
    every = R.round_robin_cap(asked, R.hardware_queries(), ["id"])
    few = R.round_robin_cap(asked, R.hardware_queries(), ["id"], limit=3).collect()
    assert every.count() == R.hardware_grid(asked, ["id"]).count()
    one = [r.source_ord for r in sorted((r for r in few if r.id == 1 and r.category == few[0].category), key=lambda r: r.pick)]
    assert one == [0, 1, 2]


def _file_stream(spark, tmp_path, rows, files):
    """A stream that reads the rows file by file."""
    for i in range(files):
        spark.createDataFrame(rows[i::files], "observed_at string, listing_status string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("observed_at string, listing_status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return source.withColumn("observed_at", F.to_timestamp("observed_at"))


def test_open_report_days_are_counted_and_corrected(spark, tmp_path):
    import zoneinfo

    # around both clock changes of the zone; the last day is not finished; one order of time within the lateness
    start = [dt.datetime(2026, 3, 7, 12), dt.datetime(2026, 10, 31, 12)]
    times_ = [s + dt.timedelta(minutes=37 * i) for s in start for i in range(90)]
    rows = [(t.strftime("%Y-%m-%d %H:%M:%S"), "active" if i % 3 else "ended") for i, t in enumerate(times_)]
    zone, want = zoneinfo.ZoneInfo("America/Los_Angeles"), {}
    for text, status in rows:
        local = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).astimezone(zone).replace(tzinfo=None)
        key = ((local - dt.timedelta(hours=8)).date(), status)
        want[key] = want.get(key, 0) + 1
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for files in (1, 4):
        source = _file_stream(spark, tmp_path / str(files), rows, files)
        found = flows.daily_report_counts(spark, source, str(tmp_path / f"out{files}"), lateness="400 days").collect()
        assert {(r.report_day, r.listing_status): r.observations for r in found} == want
        assert len(found) == len(want)


def test_a_repeated_update_batch_changes_nothing(spark, tmp_path):
    handle = flows.write_updates(str(tmp_path))
    for number, rows in ((0, [("d1", 3), ("d2", 1)]), (1, [("d2", 5)]), (1, [("d2", 5)])):
        handle(spark.createDataFrame(rows, "day string, n int"), number)
    found = flows.current_values(spark.read.parquet(str(tmp_path)), ["day"], ["n"])
    assert sorted(map(tuple, found.collect())) == [("d1", 3), ("d2", 5)]


def test_reviews_replace_what_they_say(spark):
    items = spark.createDataFrame([(1, "needs_review", "own", ("a", 1)), (2, "needs_review", None, None), (3, "watch", "own", ("b", 2))],
                                  "id int, review_status string, notes string, verification struct<verdict:string,no:int>")
    reviews = spark.createDataFrame([(1, "approved", "", 1), (1, "rejected", "", 2), (2, "approved", "new", 1), (9, "approved", "x", 1)], "id int, review_status string, notes string, no int")
    found = snapshot.review_overlay(items, reviews, "id", ["no"])
    assert sorted((r.id, r.review_status, r.notes) for r in found.collect()) == [(1, "rejected", "own"), (2, "approved", "new"), (3, "watch", "own")]
    truth = snapshot.struct_overlay(items, reviews.select("id", F.col("review_status").alias("verdict"), "no"), "id", ["no"], "verification")
    assert sorted((r.id, r.verification.verdict) for r in truth.collect()) == [(1, "rejected"), (2, "approved"), (3, "b")]


def test_region_stages_count_each_stage(spark):
    regions = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "region_name string")
    asked = spark.createDataFrame([("r1",), ("r1",), ("r2",), (None,)], "region_name string")
    judged = spark.createDataFrame([("r1", "final"), ("r1", "discovery"), ("r1", None), ("r3", "irrelevant"), (None, "final")], "region_name string, disposition string")
    rows = {r.region_name: tuple(r)[1:] for r in funnel.region_stages(regions, asked, judged, judged.filter("disposition = 'final'")).collect()}
    assert rows == {"r1": (2, 3, 2, 1, 1, "success"), "r2": (1, 0, 0, 0, 0, "success"), "r3": (0, 1, 0, 0, 0, "pending")}


def test_shop_pages_become_one_ranking(spark):
    newegg = '<div class="item-cell"><a class="item-title" href="https://n.com/1">Dell disk</a><li class="price-current">$20.00</li>Add to cart</div>'
    best = '<li class="sku-item"><a class="sku-title" href="/site/2.p">HPE disk</a><div class="priceView-customer-price"><span>$10.00</span></div>Add to Cart Shipping</li>'
    captured = {shop: spark.createDataFrame([(1, 7, html), (2, 8, ""), (3, 9, None)], "page_id int, job_id int, html string") for shop, html in (("Best Buy", best), ("Newegg", newegg))}
    rows = scans.retail_page_search(captured).orderBy("rank").collect()
    assert [(r.job_id, r.rank, r.source, r.brand, r.price) for r in rows] == [(7, 1, "Best Buy", "HPE", 10.0), (7, 2, "Newegg", "Dell", 20.0)]
    assert scans.retail_page_search(captured, mode="local").count() == 0
