"""Literal rows whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from dealsift.functions import amount, geo, times, url
from dealsift.operators import classify, hardware, requests, retail, spatial
from dealsift.sources import geofiles, pages


def value(spark, column, **inputs):
    """One result of a column expression over one row of text inputs."""
    names = list(inputs) or ["_"]
    row = tuple(inputs.values()) or ("",)
    frame = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [
    ("https://WWW.GovDeals.com/asset/12/?utm_source=x&id=5&id=6", "https://govdeals.com/asset/12?id=5"),
    ("https://www.ebay.com/itm/some-title/123456789012?hash=abc", "https://ebay.com/itm/123456789012?hash=abc"),
    ("http://x.com", "http://x.com/"),
    ("https://x.com/a?lot=&lot=a%20b&q=1", "https://x.com/a?lot=a+b"),
])
def test_canonical_url(spark, given, wanted):
    assert value(spark, url.canonical(F.col("u")), u=given) == wanted


def test_opportunity_key(spark):
    none = F.lit(None).cast("string")
    key = url.key_of(url.canonical(F.col("u")), none, none, none, none)
    assert value(spark, key, u="https://WWW.GovDeals.com/asset/12/?utm_source=x&id=5&id=6") == "govdeals.com/asset/12?id=5"


@pytest.mark.parametrize("given, wanted", [("Lot of 12 servers", 12), ("4x GPU", 4), ("spare parts", None)])
def test_quantity(spark, given, wanted):
    assert value(spark, amount.quantity(F.col("t")), t=given) == wanted


def test_condition_words(spark):
    assert value(spark, hardware.condition(F.col("t")), t="untested for parts") == "parts_only"
    assert value(spark, hardware.testing_status(F.col("t")), t="untested for parts") == "untested"
    assert value(spark, hardware.working_status(F.col("t")), t="not working") == "claimed_working"
    assert value(spark, hardware.working_status(F.col("t"), strict=True), t="not working") == "not_working"


@pytest.mark.parametrize("given, wanted", [("138000;69000", 138.0), ("345", 345.0), ("n/a", None)])
def test_voltage(spark, given, wanted):
    assert value(spark, amount.osm_voltage_kv(F.col("v")), v=given) == wanted


@pytest.mark.parametrize("status, end_hours, wanted", [
    ("active", -1, "ended"), ("unknown", 30, "active"), ("active", 10, "ending_soon"), ("unavailable", None, "needs_manual_review")])
def test_transition(spark, status, end_hours, wanted):
    now = F.lit("2026-06-01 00:00:00").cast("timestamp")
    end = F.lit(None).cast("timestamp") if end_hours is None else times.plus_hours(now, end_hours)
    none, stamp = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    moved = classify.transition(F.lit(status), end, none, none, F.lit(False), stamp, stamp, stamp, now)
    row = value(spark, moved)
    assert row["listing_status"] == wanted
    if end_hours == -1:
        assert row["end_time_verification"] == "conflicting"


def test_next_check(spark):
    checked = F.lit("2026-06-01 00:00:00").cast("timestamp")
    at = times.next_check_at(F.lit("active"), times.plus_hours(checked, 48), checked, F.lit(0))
    assert str(value(spark, at)) == "2026-06-01 06:00:00"


def test_score_retail(spark):
    row = spark.createDataFrame([("j", None, None, "In Stock", True)],
                                "job_id string, price double, distance double, inventory_status string, promotion boolean")
    assert retail.score_retail(row).first()["recommendation_score"] == 71.0


def test_unavailable_counts_as_available_unless_strict(spark):
    assert value(spark, retail.inventory_points(F.col("s")), s="Unavailable") == 1.0
    assert value(spark, retail.inventory_points(F.col("s"), strict=True), s="Unavailable") == 0.0


def test_requirement_text(spark):
    text = "帮我搜索德州和乔治亚州20英亩以上的旧制造工厂或工业土地，预算1000万美元以内，用于未来建设50MW AI数据中心。"
    row = requests.extract_criteria(spark.createDataFrame([(1, text)], "request_id int, request_text string")).first()
    # states follow the state table, not the text
    assert set(row["states"]) == {"Texas", "Georgia"}
    assert (row["min_land_acres"], row["max_price_usd"], row["target_load_mw"]) == (20.0, 10_000_000.0, 50.0)
    assert row["property_types"] == ["former manufacturing facility", "manufacturing facility", "industrial land"]
    assert row["project_use"] == "ai_data_center"


@pytest.mark.parametrize("text", ["TX", "Texas", "德州", "tx."])
def test_state_alias(spark, text):
    found = requests.alias_match(spark.createDataFrame([(text,)], "t string"), "t").collect()
    assert [r["state_code"] for r in found] == ["TX"]


def test_anchor(spark):
    row = requests.extract_criteria(spark.createDataFrame(
        [(1, "搜索 29.762731, -98.720308 周边20英里内")], "request_id int, request_text string")).first()
    assert (row["anchor_type"], row["anchor_lat"], row["anchor_lon"], row["radius_miles"]) == (
        "coordinates", 29.762731, -98.720308, 20.0)


def test_source_conflict(spark):
    rows = [("a", "osm", "transmission_line", 34.0, -83.0, 46.0, None), ("b", "gis", "transmission_line", 34.0001, -83.0, 115.0, None),
            ("c", "osm", "transmission_line", 40.0, -83.0, 500.0, None), ("d", "gis", "transmission_line", 40.0, -83.0, 500.0, None),
            ("e", "osm", "transmission_line", 45.0, -83.0, None, None)]
    assets = spark.createDataFrame(rows, "asset_id string, source_name string, asset_type string, lat double, lon double, voltage_kv double, owner string")
    found = {r["asset_id"]: r["verification_status"] for r in spatial.source_conflict(assets, 0.05).collect()}
    assert found == {"a": "conflicting", "b": "conflicting", "c": "source_confirmed", "d": "source_confirmed", "e": "estimated"}


def test_geojson_shapes(spark):
    text = ('{"features":[{"geometry":{"type":"LineString","coordinates":[[-98,30],[-99,31]]},"properties":{"name":"A","KV":"138"}},'
            '{"geometry":{"type":"MultiLineString","coordinates":[[[-98,30],[-99,31]],[[-97,30],[-97,31]]]},"properties":{"voltage_kv":69}},'
            '{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}]}')
    features = geofiles.features_of(spark.createDataFrame([(text,)], "c string"), "c")
    rows = geofiles.geojson_lines_scan(features).orderBy("feature_pos", "part").collect()
    assert [(r["voltage_kv"], r["lat"], r["lon"]) for r in rows] == [(138.0, 30.5, -98.5), (69.0, 30.5, -98.5), (69.0, 30.5, -97.0)]


def test_polyline_of_one_vertex_is_a_point(spark):
    vertices = F.array(F.struct(F.lit(30.0).alias("lat"), F.lit(-98.0).alias("lon")))
    line = geo.point_to_polyline_miles(F.lit(30.1), F.lit(-98.0), vertices)
    assert abs(value(spark, line) - value(spark, geo.haversine_miles(F.lit(30.1), F.lit(-98.0), F.lit(30.0), F.lit(-98.0)))) < 1e-9


def test_result_page_hits(spark):
    html = ('<div class="result links"><a class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fwww.a.com%2Fx">First <b>hit</b></a>'
            '<span class="result__snippet">About &amp; more</span></div><div class="result"><a class="result__a" href="">empty</a></div>')
    rows = pages.html_result_scan(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r["title"], r["url"], r["snippet"], r["domain"]) for r in rows] == [("First hit", "https://www.a.com/x", "About & more", "a.com")]


@pytest.mark.parametrize("base, link, wanted", [
    ("http://a.com/p/q", "../r", "http://a.com/r"), ("http://a.com/p/q/", "../r?x=../y", "http://a.com/p/r?x=../y"), ("http://a.com/p", "/x/./y/../z#a/../b", "http://a.com/x/z#a/../b"),
    ("http://a.com/p/", "../../..", "http://a.com/"), ("http://a.com/p/q", "r/..", "http://a.com/p/"), ("http://a.com/p", "http://b.com/x/../y", "http://b.com/x/../y"), ("http://a.com/p", "q.html", "http://a.com/q.html")])
def test_links_have_no_dot_segments(spark, base, link, wanted):
    assert value(spark, url.resolve(F.col("b"), F.col("l")), b=base, l=link) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("It&#8217;s &eacute;t&#xE9; &ndash; &amp;lt; &unknown; AT&T &#x1F600; &#0; a &lt; b&nbsp;c &", "It’s été – &lt; &unknown; AT&T \U0001F600 &#0; a < b c &"), ("plain", "plain"), ("", "")])
def test_character_references(spark, given, wanted):
    assert value(spark, pages.decode_entities(F.col("t")), t=given) == wanted


def test_links_without_quotes(spark):
    page = spark.createDataFrame([(1, "http://a.com/d/x", "<a href=/q/1>one</a> <a class=k href='/q/2'>two</a> <a href = \"q/3\">three</a>")], "page_id long, url string, html string")
    assert [r.url for r in pages.html_link_scan(page).orderBy("pos").collect()] == ["http://a.com/q/1", "http://a.com/q/2", "http://a.com/d/q/3"]


def test_countdown_beats_a_labelled_end(spark):
    text = "Auction #12 - Server lot # of Bids: 3 Auction Ends June 10, 2026 12:30 AM UTC Time Left: 2 d 3 h"
    page = spark.createDataFrame([("http://p.com/a?auc=12", text)], "source_url string, text string").withColumn("captured_at", F.lit("2026-06-01 00:00:00").cast("timestamp"))
    row = pages.public_auction_detail(page).first()
    assert str(row.end_time_utc) == "2026-06-03 03:00:00" and row.end_time_verification == "countdown_estimated" and row.listing_status == "active"


def test_long_identifiers_do_not_collide(spark):
    assert value(spark, url.listing_id(F.col("u")), u="http://a.com/x/" + "y" * 100 + "1") == "y" * 100 + "1"
