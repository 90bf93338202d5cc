"""Skew handling gives the plain result, and plans keep away from Python and cross joins."""

from pyspark.sql import Window, functions as F

from dealsift.operators import dedupe, snapshot, spatial
from dealsift.sources import tables


def sorted_rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def crowded(spark):
    """A third of the sites and assets on one point."""
    sites = spark.range(900).select(
        F.col("id").alias("site_id"), F.when(F.col("id") % 3 == 0, 30.0).otherwise(29 + F.col("id") % 40 / 10).alias("lat"),
        F.when(F.col("id") % 3 == 0, -98.0).otherwise(-97 - F.col("id") % 35 / 10).alias("lon"))
    assets = spark.range(300).select(
        F.col("id").alias("asset_id"), F.lit("substation").alias("asset_type"), (F.col("id") % 5 * 69.0).alias("voltage_kv"),
        F.when(F.col("id") % 3 == 0, 30.0).otherwise(29 + F.col("id") % 50 / 12).alias("lat"),
        F.when(F.col("id") % 3 == 0, -98.0).otherwise(-97 - F.col("id") % 45 / 12).alias("lon"))
    return sites, assets


def test_radius_join_is_brute_force_also_with_split_cells(spark):
    sites, assets = crowded(spark)
    miles = F.round(spatial.geo.haversine_miles(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")), 3)
    brute = sites.crossJoin(assets.withColumnsRenamed({"lat": "alat", "lon": "alon"})).withColumn("d", miles).filter("d <= 15").select("site_id", "asset_id", "d")
    wanted = sorted_rows(brute)
    for limit in (200_000, 20):
        got = spatial.radius_join(sites, assets, 15.0, rows_per_task=limit).select("site_id", "asset_id", "distance_miles")
        assert sorted_rows(got) == wanted


def test_radius_join_across_the_date_line(spark):
    sites = spark.createDataFrame([(1, 52.0, 179.95), (2, 52.0, -179.95)], "site_id int, lat double, lon double")
    assets = spark.createDataFrame([(7, "tower", 52.0, -179.99)], "asset_id int, asset_type string, lat double, lon double")
    assert {r["site_id"] for r in spatial.radius_join(sites, assets, 10.0).collect()} == {1, 2}


def test_power_summary_matches_the_plain_operators(spark):
    sites, assets = crowded(spark)
    pairs = spatial.expanding_ring(spatial.radius_join(sites, assets, 20.0), radii=[5.0, 20.0])
    wanted = pairs.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.min("distance_miles").alias("near"))
    got = spatial.power_summary(sites, assets, [5.0, 20.0], rows_per_task=20).filter("asset_count > 0").select(
        "site_id", F.col("asset_count").alias("n"), F.col("nearest_substation_miles").alias("near"))
    assert sorted_rows(got) == sorted_rows(wanted)


def test_previous_row_of_a_hot_key(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("event_id"),
        F.timestamp_add("HOUR", (F.col("id") / 3).cast("int"), F.lit("2026-01-01").cast("timestamp")).alias("at"), (F.col("id") % 7).alias("v"))
    got = snapshot.with_previous(rows, "k", "at", ["event_id"], ["v"]).select("event_id", F.col("previous.v").alias("p"))
    plain = rows.select("event_id", F.lag("v").over(Window.partitionBy("k").orderBy("at", "event_id")).alias("p"))
    assert sorted_rows(got) == sorted_rows(plain)


def test_first_wins_and_marks_agree_and_are_idempotent(spark):
    rows = spark.range(3000).select((F.col("id") % 100 * (F.col("id") % 3 > 0).cast("int")).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v"))
    first = dedupe.first_wins(rows, ["k"], ["o"], "dropped")
    assert first.agg(F.sum("dropped") + F.count(F.lit(1))).first()[0] == 3000
    assert sorted_rows(first.drop("dropped")) == sorted_rows(dedupe.mark_first(rows, ["k"], ["o"]).filter("is_first").drop("is_first"))
    assert sorted_rows(dedupe.first_wins(first.drop("dropped"), ["k"], ["o"])) == sorted_rows(first.drop("dropped"))


def test_salted_join_is_a_join(spark):
    left = spark.range(500).select((F.col("id") % 5 * (F.col("id") % 2)).alias("k"), F.col("id").alias("l"))
    right = spark.range(300).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("r"))
    assert sorted_rows(dedupe.salted_join(left, right, ["k"], "l", "r", 40)) == sorted_rows(left.join(right, "k"))


def test_writing_a_version_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 3, "n"), ("c", 4, "z")], "k string, v int, w string")
    tables.write_snapshot(old, root, 0)
    for _ in range(2):
        tables.upsert_sink(new, root, ["k"], ["v"], 1)
        assert sorted_rows(tables.read_snapshot(spark, root)) == [("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")]


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


def test_plans(spark):
    import __spark_entry__ as entry

    queries, sf = entry.queries(), "/root/testdata/sf0.001"
    for name in ("normalize_hardware", "radius_join", "site_search", "extract_criteria", "html_link_scan", "first_wins_dedupe"):
        text = plan(queries[name](spark, sf))
        assert "PythonUDF" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text, name
        assert "CartesianProduct" not in text, name
    assert "html" not in plan(queries["source_run_summary"](spark, sf))
    scan = plan(queries["price_bounds"](spark, sf))
    assert "ReadSchema: struct<p_brand:string,p_retailprice:double>" in scan.replace("\n", "") or "p_name" not in scan.split("Physical Plan")[1]


def test_upsert_batches_in_any_order_give_one_snapshot(spark, tmp_path):
    from dealsift.sources.tables import read_snapshot
    from dealsift.streaming.flows import stream_upsert

    rows = [(f"k{i % 4}", f"2026-01-{1 + i % 9:02d} 00:00:00", i, float(i % 5), i % 3, "active" if i % 2 else "ended") for i in range(24)]
    columns = "opportunity_key string, observed_at string, event_id long, total_price_usd double, quantity int, listing_status string"

    def run(name, batches):
        handle = stream_upsert(str(tmp_path / name / "snapshot"), str(tmp_path / name / "history"),
                               ["total_price_usd", "quantity", "listing_status", "observed_at", "last_seen_at", "event_id"])
        for number, batch in enumerate(batches):
            handle(spark.createDataFrame(batch, columns).withColumn("observed_at", F.col("observed_at").cast("timestamp")), number)
        found = read_snapshot(spark, str(tmp_path / name / "snapshot"))
        return sorted(map(tuple, found.select(sorted(found.columns)).collect()))

    assert run("one", [rows]) == run("late", [rows[12:], [], rows[:6], rows[6:12]])


def test_split_is_disjoint_and_complete(spark):
    rows = spark.createDataFrame([(i, ["final", "discovery", "duplicate", "irrelevant"][i % 4]) for i in range(40)], "n int, disposition string")
    parts = [{r.n for r in part.collect()} for part in dedupe.split_outputs(rows)]
    assert set().union(*parts) == set(range(40)) and sum(map(len, parts)) == 40


def _crowd(seed: int, n: int, spread: float):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lon = 30 + rng.random() * spread, (179.9995 if seed % 2 else -98.0) + rng.random() * spread
        rows.append((f"a{i}", rng.choice(["osm", "gis", "eia", None]), rng.choice(["line", "line", "substation", None]), lat if i % 17 else None,
                     lon - 360 if lon > 180 else lon, rng.choice([None, 138.0, 138.0, 46.0]), rng.choice([None, None, "x", "y"])))
    return rows + [(f"copy{i}", *rows[i][1:]) for i in range(0, n, 5)]


_ASSET = "asset_id string, source_name string, asset_type string, lat double, lon double, voltage_kv double, owner string"


def test_source_conflict_equals_brute_force(spark):
    import math

    def miles(a, b):
        p, q = math.radians(a[3]), math.radians(b[3])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 3958.7613 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    def status(a, rows):
        near = [b for b in rows if None not in (*a[1:5], *b[1:5]) and a[1] != b[1] and a[2] == b[2] and miles(a, b) <= 0.05]
        other = any(x is not None and y is not None and x != y for b in near for x, y in ((a[5], b[5]), (a[6], b[6])))
        return "estimated" if not near else "conflicting" if other else "source_confirmed"

    for seed, spread in ((1, 0.002), (2, 0.01), (3, 0.03)):
        rows = _crowd(seed, 120, spread)
        found = {r.asset_id: r.verification_status for r in spatial.source_conflict(spark.createDataFrame(rows, _ASSET), 0.05).collect()}
        assert found == {a[0]: status(a, rows) for a in rows}


def test_a_crowded_place_is_judged_without_pairs(spark):
    rows = [(i, ["osm", "gis"][i % 2], "line", 30 + i * 1e-9, -98.0, 138.0, None) for i in range(3000)]
    rows += [(5000 + i, ["osm", "gis"][i % 2], "line", 40 + i * 1e-9, -98.0, float(i % 7), None) for i in range(3000)]
    readings = spark.createDataFrame(rows, _ASSET.replace("asset_id string", "reading_id long"))
    found = {r.verdict: r["count"] for r in spatial.judged_readings(readings, 0.05).groupBy("verdict").count().collect()}
    assert found == {"source_confirmed": 3000, "conflicting": 3000}
