"""Places in an order against sorting all rows, and the left join by radius against the join by site."""

import random

from dealsift.operators import spatial


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_distance_sort_deals_pairs_once_and_numbers_them(spark, monkeypatch):
    rng = random.Random(3)
    near = [(rng.randrange(40), rng.choice([None, *range(30)]), rng.choice([None, 0.0, 0.0, 0.0, 1.5, 2.25, rng.randrange(50) / 8])) for _ in range(400)]
    rows = spark.createDataFrame(list(dict.fromkeys(near)), "site_id long, asset_id long, distance_miles double")
    plain = sorted(rows.collect(), key=lambda r: [(x is None, x or 0) for x in (r.distance_miles, r.site_id, r.asset_id)])
    want = [(*r, i) for i, r in enumerate(plain, 1)]
    for limit in (10_000, 20):  # without and with values of too many rows
        got = spatial.distance_sort(rows, "distance_miles", "site_id", "asset_id", position="position", few_values=True, rows_per_task=limit)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == want
    got = spatial.distance_sort(rows, "distance_miles", "site_id", "asset_id", position="position", few_values=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_left_join_by_radius_is_the_join_by_site(spark):
    sites = spark.createDataFrame(
        [(1, 30.0, -98.0), (1, 30.0, -98.0), (2, 30.1, -98.0), (2, 45.0, -98.0), (3, 45.0, -98.0), (3, 45.0, -98.0), (4, None, None), (None, 30.0, -98.0)],
        "site_id long, lat double, lon double")
    assets = spark.createDataFrame([(7, "plant", 30.0, -98.1), (7, "plant", 30.0, -98.1), (8, "plant", 30.2, -98.0), (None, "plant", 30.0, -98.0), (9, "plant", None, 1.0)],
                                   "asset_id long, asset_type string, lat double, lon double")
    near = spatial.radius_join(sites, assets, 50.0).select("site_id", "asset_id", "distance_miles")
    assert _rows(spatial.radius_left_join(sites, assets, 50.0)) == _rows(sites.select("site_id").join(near, "site_id", "left"))
