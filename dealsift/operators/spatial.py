"""Sites against nearby assets: grid joins, rings, nearest, counts and source conflicts.

A site lies in one grid cell.  An asset is listed in every cell its surroundings can
reach, so a plain equi join on the cell finds each candidate pair once; the exact
distance then decides.  Crowded cells are split on both sides.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealsift import rules
from dealsift.functions import geo
from dealsift.functions.fence import keep_rows
from dealsift.functions.text import once
from dealsift.operators.dedupe import salted_join
from dealsift.operators.positions import ordered, with_position_in_groups

# distances are compared after rounding to 3 decimals, so the grid reaches a little further
_SLACK_MILES = 0.001
# candidate pairs of sites and lines that one task measures
_LINE_PAIRS_PER_TASK = 5_000_000
# segments of a line near one cell that are measured in compiled code
_FEW_SEGMENTS = 4


def _cell_degrees(radius: float) -> float:
    return (radius + _SLACK_MILES) / rules.MILES_PER_DEGREE_LAT


def with_cell(points: DataFrame, radius: float) -> DataFrame:
    size = F.lit(_cell_degrees(radius))
    return points.withColumns({
        "_row": F.floor(F.col("lat") / size), "_col": F.floor(F.col("lon") / size)})


def _covering_cells(south: Column, north: Column, west: Column, east: Column, radius: float, side: float | None = None) -> Column:
    """Cells of a box widened by the radius, also across the date line; their side is the radius unless given."""
    size = F.lit(_cell_degrees(radius) if side is None else side)
    widened = F.lit(_cell_degrees(radius))
    none = F.array().cast("array<bigint>")

    # each step names its results, else every cell would compute the box again
    def around(box: Column) -> Column:
        polar = F.least(F.lit(89.9), F.greatest(F.abs(box["low"]), F.abs(box["high"])))
        reach = F.lit(_cell_degrees(radius) * 1.01) / F.cos(F.radians(polar))
        return once(reach, lambda x: once(F.struct((box["west"] - x).alias("left"), (box["east"] + x).alias("right")), lambda sides: cells(box, sides)))

    def cells(box: Column, sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        rows = F.sequence(F.floor(box["low"] / size), F.floor(box["high"] / size))

        def columns(shift: float) -> Column:
            return F.sequence(F.floor((left + shift) / size), F.floor((right + shift) / size))

        cols = F.concat(
            columns(0.0), F.when(left < -180, columns(360.0)).otherwise(none),
            F.when(right > 180, columns(-360.0)).otherwise(none))
        return once(cols, lambda cs: F.flatten(F.transform(rows, lambda r: F.transform(cs, lambda c: F.struct(r.alias("r"), c.alias("c"))))))

    return once(F.struct((south - widened).alias("low"), (north + widened).alias("high"), west.alias("west"), east.alias("east")), around)


def _segment_cells(segments: Column, radius: float) -> Column:
    """Per segment of a polyline the cells within its reach.  Long segments are cut into cell-sized pieces first."""
    size = F.lit(_cell_degrees(radius))

    def cells(a: Column, b: Column) -> Column:
        dy, dx = b["lat"] - a["lat"], b["lon"] - a["lon"]
        count = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dy), F.abs(dx)) / size).cast("int"))

        def piece(i: Column, pieces: Column) -> Column:
            at, to = i / pieces, (i + 1) / pieces
            ends = F.struct((a["lat"] + dy * at).alias("y0"), (a["lat"] + dy * to).alias("y1"), (a["lon"] + dx * at).alias("x0"), (a["lon"] + dx * to).alias("x1"))
            return once(ends, lambda e: _covering_cells(
                F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]), F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"]), radius))

        # as one number each, for which distinct values are found by hash
        numbered = once(count, lambda pieces: F.transform(
            F.flatten(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: piece(i, pieces))), _cell_number))
        return F.array_distinct(numbered)

    return F.transform(segments, lambda s: cells(s["a"], s["b"]))


def _cell_number(cell: Column) -> Column:
    return F.shiftleft(cell["r"], 32) + cell["c"]


def _cell_of(number: Column) -> tuple[Column, Column]:
    """Row and column of a cell number; both may be negative."""
    half = F.lit(1 << 31)
    column = (number + half).bitwiseAND(F.lit((1 << 32) - 1)) - half
    return F.shiftright(number - column, 32), column


def few_segments_distance(site_lat: Column, site_lon: Column) -> Column:
    """Distance to a line with few segments near; no lambda, which compiled code cannot enter. Missing segments are null and do not count."""
    return F.least(*[geo.segment_miles(site_lat, site_lon, F.get("_near", F.lit(i))) for i in range(_FEW_SEGMENTS)])


def asset_distance(site_lat: Column, site_lon: Column, assets_have_lines: bool, few: Column | None = None) -> Column:
    """Polylines by planar segment distance, all other assets by great circle; expects the columns of ``_reach``.

    ``few`` is the distance to lines with few segments, if a column has it already."""
    point = geo.haversine_miles(site_lat, site_lon, F.col("asset_lat"), F.col("asset_lon"))
    if not assets_have_lines:
        return point
    count = F.size("_near")
    many = F.array_min(F.transform("_near", lambda s: geo.segment_miles(site_lat, site_lon, s)))
    single = geo.point_to_polyline_miles(site_lat, site_lon, F.slice("vertices", 1, 1))
    few = few_segments_distance(site_lat, site_lon) if few is None else few
    return F.when(count.between(1, _FEW_SEGMENTS), few).when(count > 0, many).when(_is_line(), single).otherwise(point)


def _is_line() -> Column:
    return (F.col("asset_type") == "transmission_line") & (F.size("vertices") > 0)


def _reach(assets: DataFrame, radius: float) -> DataFrame:
    """A row per asset and cell within reach of it; of a line the row also has the segments within reach of the cell.

    The other segments are farther from every site of the cell than the radius, so the nearest one is among them.
    """
    spot = _covering_cells(F.col("asset_lat"), F.col("asset_lat"), F.col("asset_lon"), F.col("asset_lon"), radius)
    reach = assets.withColumnsRenamed({"lat": "asset_lat", "lon": "asset_lon"})
    reach = reach.filter(F.col("asset_lat").isNotNull() & F.col("asset_lon").isNotNull())
    if "vertices" not in assets.columns:
        return reach.withColumn("_cell", F.explode(spot)).withColumns({"_row": F.col("_cell.r"), "_col": F.col("_cell.c")}).drop("_cell")
    # few rows with long work each: a line covers hundreds of cells
    spark = assets.sparkSession
    reach = reach.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    reach = reach.withColumn("_segments", F.when(_is_line(), geo.segments(F.col("vertices"))))
    reach = reach.withColumn("_cells", _segment_cells(F.col("_segments"), radius))
    covered = F.when(_is_line(), F.array_distinct(F.flatten("_cells"))).otherwise(F.transform(spot, _cell_number))
    reach = reach.withColumn("_cell", F.explode(covered))
    near = F.filter("_segments", lambda s, i: F.array_contains(F.get("_cells", i), F.col("_cell")))
    row, column = _cell_of(F.col("_cell"))
    # a single vertex is measured by great circle
    return reach.withColumns({"_near": F.when(F.size("vertices") > 1, near), "_row": row, "_col": column}).drop("_segments", "_cells", "_cell")


def _located(sites: DataFrame, radius: float) -> DataFrame:
    return with_cell(sites.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()), radius)


def _within(exact: Column, rounded: Column, radius: float, assets: DataFrame) -> Column:
    if "ring_limited" in assets.columns:
        return F.when(F.col("ring_limited"), rounded <= radius).otherwise(exact <= radius)
    return rounded <= radius


def radius_join(sites: DataFrame, assets: DataFrame, radius: float, site_id: str = "site_id",
                asset_id: str = "asset_id", rows_per_task: int = 200_000, pairs_per_task: int | None = None) -> DataFrame:
    """All site-asset pairs within the radius, with the distance in miles (3 decimals).

    The rounded distance decides, except for assets marked ``ring_limited = false``
    (imported line sets), where the exact one does.  Sites need ``lat`` and ``lon``;
    assets also ``asset_type`` and may have ``vertices``.
    """
    has_lines = "vertices" in assets.columns
    if has_lines and pairs_per_task is None:
        # a line meets thousands of sites, so few bytes of input make very many pairs
        pairs_per_task = _LINE_PAIRS_PER_TASK
    pairs = salted_join(_located(sites, radius), _reach(assets, radius), ["_row", "_col"], site_id, asset_id, rows_per_task, pairs_per_task)
    pairs = pairs.drop("_row", "_col")
    lat, lon = F.col("lat"), F.col("lon")
    if has_lines:
        # measured once; most candidates are dropped before they are rounded, which costs more than the distance
        pairs = pairs.withColumn("_few", few_segments_distance(lat, lon)).withColumn("distance_exact", asset_distance(lat, lon, True, F.col("_few")))
        pairs = keep_rows(pairs, F.col("distance_exact") <= radius + _SLACK_MILES).drop("_near", "_few")
    else:
        pairs = pairs.withColumn("distance_exact", asset_distance(lat, lon, False))
    pairs = pairs.withColumn("distance_miles", F.round("distance_exact", 3))
    return pairs.filter(_within(F.col("distance_exact"), F.col("distance_miles"), radius, assets))


def radius_left_join(sites: DataFrame, assets: DataFrame, radius: float, site_id: str = "site_id", asset_id: str = "asset_id",
                     pairs_per_task: int = 20_000_000) -> DataFrame:
    """Site, asset and distance of all pairs within the radius, and a row without asset for every other site.

    The rows are those of a left join of the sites with ``radius_join`` by the site id, but no pair is shuffled: of an id
    found in n rows each row is repeated n times before the search, and sites without asset come from a semi join that
    stops at a site's first asset.
    """
    copies = sites.groupBy(site_id).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = sites.join(copies, site_id).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies", "_copy")
    near = radius_join(repeated, assets, radius, site_id, asset_id, pairs_per_task=pairs_per_task).select(site_id, asset_id, "distance_miles")
    at, reach = _located(sites, radius).alias("at"), _reach(assets, radius).withColumnsRenamed({"_row": "_asset_row", "_col": "_asset_col"})
    if site_id in reach.columns:
        reach = reach.drop(site_id)
    exact = asset_distance(F.col("at.lat"), F.col("at.lon"), "vertices" in assets.columns)
    meets = (F.col("_row") == F.col("_asset_row")) & (F.col("_col") == F.col("_asset_col")) & _within(exact, F.round(exact, 3), radius, assets)
    served = at.join(reach, meets, "left_semi").select(site_id).distinct()
    kinds = near.schema
    alone = sites.select(site_id).join(served, site_id, "left_anti").select(
        site_id, *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in (asset_id, "distance_miles")])
    return near.unionByName(alone)


def bbox_prefilter(sites: DataFrame, radius: float) -> DataFrame:
    """Bounding box of the search circle around each site."""
    return sites.withColumn("_box", geo.envelope(F.col("lat"), F.col("lon"), radius)).select(*sites.columns, "_box.*")


def ring_of(distance: Column, radii=None) -> Column:
    """Smallest search radius that covers the distance."""
    return F.coalesce(*[F.when(distance <= r, F.lit(float(r))) for r in sorted(radii or rules.RADII_MILES)])


def expanding_ring(pairs: DataFrame, site_id: str = "site_id", radii=None) -> DataFrame:
    """Keep, per site, the assets within the first radius that has any."""
    ring = ring_of(F.col("distance_miles"), radii)
    first = pairs.groupBy(site_id).agg(F.min(ring).alias("ring_miles"))
    return pairs.join(first, site_id).filter(F.col("distance_miles") <= F.col("ring_miles"))


def nearest_asset(pairs: DataFrame, site_id: str = "site_id", asset_id: str = "asset_id") -> DataFrame:
    """Closest asset per site and type; a distance of zero counts as closest."""
    details = [c for c in ("distance_miles", asset_id, "voltage_kv", "asset_name", "owner") if c in pairs.columns]
    return pairs.groupBy(site_id, "asset_type").agg(
        F.min_by(F.struct(*details), F.struct("distance_exact", asset_id)).alias("_near")
    ).select(site_id, "asset_type", "_near.*")


def radius_counts(pairs: DataFrame, site_id: str = "site_id", radii=None) -> DataFrame:
    """Number of assets within each radius per site, one column per radius."""
    return pairs.groupBy(site_id).agg(*[
        F.count_if(F.col("distance_miles") <= r).alias(f"within_{r:g}_mile") for r in radii or rules.RADII_MILES])


def counts_map(radii=None) -> Column:
    """The radius counts as one map column."""
    chosen = radii or rules.RADII_MILES
    return F.create_map(*[x for r in chosen for x in (F.lit(f"{r:g}_mile"), F.col(f"within_{r:g}_mile"))])


def highest_voltage(pairs: DataFrame, site_id: str = "site_id") -> DataFrame:
    known = F.when(F.col("voltage_kv") != 0, F.col("voltage_kv"))
    return pairs.groupBy(site_id).agg(F.max(known).alias("known_voltage_kv"))


def site_assets(pairs: DataFrame, site_id: str = "site_id", asset_id: str = "asset_id") -> DataFrame:
    """Assets of each site, nearest first, as ordered rows rather than one array per site."""
    return distance_sort(pairs, site_id, "distance_miles", asset_id)


def distance_sort(df: DataFrame, *columns: str, position: str | None = None, few_values: bool = False, rows_per_task: int = 2_000_000) -> DataFrame:
    """Ascending order with missing distances last.

    ``few_values`` says that the first column has far fewer values than there are rows, as rounded distances of one
    radius do; positions then cost one shuffle and no written rows.
    """
    if few_values and position is not None:
        return with_position_in_groups(df, columns[0], [F.asc_nulls_last(c) for c in columns[1:]], position, rows_per_task)
    return ordered(df, [F.asc_nulls_last(c) for c in columns], position)


def anchor_distance(sites: DataFrame, anchors: DataFrame, job: str = "job_id") -> DataFrame:
    """Distance of each site to the centre of its search; ``outside_radius`` marks sites to remove.

    Sites or searches without coordinates are kept and flagged.
    """
    centre = anchors.select(
        job, F.col("lat").alias("_a_lat"), F.col("lon").alias("_a_lon"), F.col("radius_miles").alias("_a_radius"))
    joined = sites.join(centre, job, "left")
    miles = F.round(geo.haversine_miles(F.col("_a_lat"), F.col("_a_lon"), F.col("lat"), F.col("lon")), 3)
    anchored = F.col("_a_lat").isNotNull() & F.col("_a_lon").isNotNull()
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return joined.withColumns({
        "distance_to_search_anchor_miles": miles,
        "anchor_flag": F.when(anchored & ~located, F.lit("needs_verification: distance_to_search_anchor unknown")),
        "outside_radius": F.coalesce((F.nullif("_a_radius", F.lit(0.0)) < miles), F.lit(False)),
    }).drop("_a_lat", "_a_lon", "_a_radius")


_READING = ["source_name", "asset_type", "lat", "lon", "voltage_kv", "owner"]


def _close_cell(tolerance: float) -> float:
    """Side in degrees of a cell so small that any two points in it lie within the tolerance."""
    return 0.7 * tolerance / rules.MILES_PER_DEGREE_LAT


def _extremes(df: DataFrame, *keys: str) -> DataFrame:
    names = ["voltage_kv", "owner", "source_name"]
    have = {f"{end}_{n}": f"{end}_{n}" if f"{end}_{n}" in df.columns else n for n in names for end in ("least", "most")}
    return df.groupBy(*keys).agg(*[
        (F.min if name.startswith("least") else F.max)(source).alias(name) for name, source in have.items()])


def _cell_verdict(readings: DataFrame) -> DataFrame:
    """Readings with what their own cell says: whether another source is there, and whether one of those differs.

    A cell is summed up per source by its extremes. Of all sources but one, the extremes are the first or the second best of
    the cell, so a reading meets a fixed number of values, however many readings the cell has.
    """
    cell = ["asset_type", "_row", "_col"]
    per_source = _extremes(readings.withColumn("_source", F.col("source_name")), *cell, "_source")

    def best_two(name: str, end: str) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(F.col(f"{end}_{name}").isNotNull(), F.struct(f"{end}_{name}", "_source"))))
        return F.slice(ranked, 1, 2) if end == "least" else F.slice(F.reverse(ranked), 1, 2)

    names = [(n, e) for n in ("voltage_kv", "owner") for e in ("least", "most")]
    summary = per_source.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_sources"), *[best_two(n, e).alias(f"_{e}_{n}") for n, e in names])
    joined = readings.join(summary, cell, "left")

    def differs(name: str, end: str) -> Column:
        # of two entries at most one is of the reading's own source
        others = F.filter(F.col(f"_{end}_{name}"), lambda x: x["_source"] != F.col("source_name"))
        return F.coalesce(F.get(others, F.lit(0))[f"{end}_{name}"] != F.col(name), F.lit(False))

    return joined.withColumns({
        "_met": F.coalesce(F.col("_sources") > 1, F.lit(False)),
        "_contradicted": reduce(Column.__or__, [differs(n, e) for n, e in names]),
    }).drop("_sources", *[f"_{e}_{n}" for n, e in names])


def judged_readings(readings: DataFrame, tolerance_miles: float) -> DataFrame:
    """Distinct readings with ``verdict``: conflicting, source_confirmed, estimated, or null where distances must decide.

    Cells are so small that all readings in one are at the same place. Null remains where the cells around a reading,
    as far as the tolerance reaches, hold another source and not one voltage and owner only.
    """
    size = _close_cell(tolerance_miles)
    placed = readings.withColumns({"_row": F.floor(F.col("lat") / size), "_col": F.floor(F.col("lon") / size)})
    usable = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("source_name", "asset_type", "_row", "_col")])
    own = _cell_verdict(placed.filter(usable))
    cells = _extremes(placed.filter(usable), "asset_type", "_row", "_col")
    south, west = F.col("_row") * size, F.col("_col") * size
    reached = cells.withColumn("_cell", F.explode(
        _covering_cells(south, south + size, west, west + size, tolerance_miles, size)))
    around = _extremes(reached.drop("_row", "_col").select(
        "*", F.col("_cell.r").alias("_row"), F.col("_cell.c").alias("_col")), "asset_type", "_row", "_col")
    joined = own.join(around, ["asset_type", "_row", "_col"], "left")
    alone = F.col("least_source_name") == F.col("most_source_name")
    # extremes are null where no reading around has a value
    alike = reduce(Column.__and__, [F.col(f"least_{n}").eqNullSafe(F.col(f"most_{n}")) for n in ("voltage_kv", "owner")])
    verdict = (F.when(F.col("_contradicted"), F.lit("conflicting")).when(alone, F.lit("estimated"))
               .when(F.col("_met") & alike, F.lit("source_confirmed")))
    decided = joined.select(*readings.columns, verdict.alias("verdict"))
    return decided.unionByName(placed.filter(~usable).select(*readings.columns, F.lit("estimated").alias("verdict")))


def source_conflict(assets: DataFrame, tolerance_miles: float, asset_id: str = "asset_id") -> DataFrame:
    """Whether other sources confirm or contradict an asset at its place.

    Copies of a reading at a point count once. Most readings are judged by sums over small cells, linear in the readings of a
    crowded place; only those near a differing or not yet confirming neighbour cell are measured. The tolerance is positive.
    Assets without coordinates, source or type are ``estimated`` and say nothing about others.
    """
    merged = assets.groupBy(*_READING).agg(F.min(asset_id).alias("reading_id"))
    judged = judged_readings(merged, tolerance_miles)
    others = merged.withColumnsRenamed({
        "source_name": "other_source", "voltage_kv": "other_voltage", "owner": "other_owner",
        "reading_id": "other_id", "asset_type": "other_type"})
    near = _same_place(judged.filter(F.col("verdict").isNull()), others, tolerance_miles)

    def differs(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) != F.col(b), F.lit(False))

    measured = near.groupBy("reading_id").agg(
        F.max(differs("voltage_kv", "other_voltage") | differs("owner", "other_owner")).alias("_contradicted"))
    joined = judged.join(measured, "reading_id", "left").withColumn("verification_status", F.coalesce(
        "verdict", F.when(F.col("_contradicted").isNull(), F.lit("estimated"))
        .when(F.col("_contradicted"), F.lit("conflicting")).otherwise(F.lit("source_confirmed"))))
    verdicts = joined.select(*[F.col(c).alias(f"_r_{c}") for c in _READING], "verification_status")
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in _READING]
    return assets.join(verdicts, reduce(Column.__and__, same)).select(*assets.columns, "verification_status")


def _same_place(readings: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """Readings of different sources and equal type within the tolerance."""
    spread = others.withColumnsRenamed({"lat": "asset_lat", "lon": "asset_lon"})
    cells = _covering_cells(F.col("asset_lat"), F.col("asset_lat"), F.col("asset_lon"), F.col("asset_lon"), tolerance)
    spread = spread.withColumn("_cell", F.explode(cells)).withColumns(
        {"_row": F.col("_cell.r"), "_col": F.col("_cell.c")}).drop("_cell")
    pairs = salted_join(with_cell(readings, tolerance), spread, ["_row", "_col"], "reading_id", "other_id")
    return pairs.filter(
        (F.col("source_name") != F.col("other_source")) & (F.col("asset_type") == F.col("other_type"))
        & (geo.haversine_miles(F.col("lat"), F.col("lon"), F.col("asset_lat"), F.col("asset_lon")) <= tolerance))


# ------------------------------------------------------------- geocoding

def raw_address() -> Column:
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("address_line_1", "city", "state", "zip_code")]
    return F.concat_ws(", ", *parts)


def has_complete_address() -> Column:
    complete = F.lit(True)
    for name in ("address_line_1", "city", "state", "zip_code"):
        complete = complete & (F.coalesce(F.col(name), F.lit("")) != "")
    return complete


def geocode_gate(sites: DataFrame) -> DataFrame:
    """Status and confidence of the coordinates, and whether distances may be computed."""
    placed = F.coalesce((F.col("lat") != 0) & (F.col("lon") != 0), F.lit(False))
    found = F.col("geocode_found") if "geocode_found" in sites.columns else F.lit(False)
    status = (
        F.when(placed & ~found, F.lit("verified_address"))
        .when(found, F.lit("geocoded_address"))
        .when(has_complete_address(), F.lit("geocoding_failed"))
        .when(raw_address() != "", F.lit("partial_address"))
        .otherwise(F.lit("address_needs_verification"))
    )
    confidence = (
        F.when(placed & ~found, F.lit(0.95)).when(found, F.lit(0.9))
        .when(has_complete_address(), F.lit(0.0)).otherwise(F.lit(0.2))
    )
    gated = sites.withColumns({"geocoding_status": status, "geocoding_confidence": confidence})
    usable = F.col("geocoding_status").isin("verified_address", "geocoded_address") & F.col("lat").isNotNull() & (
        F.col("lon").isNotNull()) & (F.col("geocoding_confidence") >= 0.7)
    return gated.withColumn("can_calculate_distances", F.coalesce(usable, F.lit(False)))


def address_variants(address: Column) -> Column:
    """The address followed by its rewrites, in the order they are tried."""
    rewrites = [
        F.when(address.contains(old), F.replace(address, F.lit(old), F.lit(new))) for old, new in rules.ADDRESS_REWRITES]
    return F.array_distinct(F.array_compact(F.array(address, *rewrites)))


def geocode_lookup(sites: DataFrame, reference: DataFrame, site_id: str = "site_id") -> DataFrame:
    """Coordinates of complete addresses from a reference table (``address``, ``ref_lat``, ``ref_lon``).

    Existing coordinates win, then the exact address, then its rewrites in order.
    Distinct addresses are looked up, so repeated ones cost one row.
    """
    known = reference.select(F.lower("address").alias("_variant"), "ref_lat", "ref_lon")
    asked = sites.withColumn("_address", F.lower(raw_address()))
    open_sites = asked.filter(
        has_complete_address() & ~F.coalesce((F.col("lat") != 0) & (F.col("lon") != 0), F.lit(False)))
    wanted = open_sites.groupBy("_address").agg(F.first(raw_address()).alias("_text"))
    tried = wanted.select("_address", F.posexplode(address_variants(F.col("_text"))).alias("_rank", "_variant"))
    hits = tried.withColumn("_variant", F.lower("_variant")).join(known, "_variant").groupBy("_address").agg(
        F.min_by(F.struct("ref_lat", "ref_lon"), "_rank").alias("_hit"))
    located = asked.join(hits, "_address", "left")
    missing = ~F.coalesce((F.col("lat") != 0) & (F.col("lon") != 0), F.lit(False)) & has_complete_address()
    found = missing & F.col("_hit").isNotNull()
    result = located.withColumns({
        "geocode_found": found,
        "lat": F.when(found, F.col("_hit.ref_lat")).otherwise(F.col("lat")),
        "lon": F.when(found, F.col("_hit.ref_lon")).otherwise(F.col("lon")),
    })
    return geocode_gate(result.drop("_hit", "_address"))


def anchor_resolve(anchors: DataFrame, zips: DataFrame) -> DataFrame:
    """Centre of each search: its own coordinates in the right order, else the centre of its ZIP."""
    known = zips.select(
        F.col("zip_code").alias("_zip"), F.col("lat").alias("_z_lat"), F.col("lon").alias("_z_lon"),
        F.col("state").alias("_z_state"))
    joined = anchors.join(known, F.substring(F.col("anchor_zip"), 1, 5) == F.col("_zip"), "left")
    given = F.col("first_coordinate").isNotNull() & F.col("second_coordinate").isNotNull()
    pair = geo.normalize_pair(F.col("first_coordinate"), F.col("second_coordinate"))
    return joined.withColumn("_pair", pair).withColumns({
        "lat": F.when(given, F.col("_pair.lat")).otherwise(F.col("_z_lat")),
        "lon": F.when(given, F.col("_pair.lon")).otherwise(F.col("_z_lon")),
        "anchor_state": F.when(~given, F.col("_z_state")),
        "anchor_status": F.when(given | F.col("_z_lat").isNotNull(), F.lit("resolved")).otherwise(F.lit("failed")),
    }).drop("_pair", "_zip", "_z_lat", "_z_lon", "_z_state")


# ------------------------------------------------------------- per-site summary

def power_summary(sites: DataFrame, assets: DataFrame, radii=None, site_id: str = "site_id",
                  asset_id: str = "asset_id", rings: bool = True, rows_per_task: int = 200_000) -> DataFrame:
    """Nearest substation and line, radius counts and highest voltage per site.

    Sites on the same point share one search, so copies are screened once.  With
    ``rings`` point assets count up to the first radius that has any asset; lines of
    other sources always count up to the largest radius.
    """
    chosen = sorted(radii or rules.RADII_MILES)
    points = sites.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
    points = points.withColumn("point_id", F.xxhash64("lat", "lon"))
    pairs = radius_join(points, assets, chosen[-1], "point_id", asset_id, rows_per_task)
    limited = F.lit(rings)
    if rings and "ring_limited" in assets.columns:
        limited = F.coalesce("ring_limited", F.lit(True))
    known = F.when(F.col("voltage_kv") != 0, F.col("voltage_kv"))

    def closest(kind: str) -> Column:
        of_kind = F.col("asset_type") == kind
        found = F.struct("distance_exact", F.col(asset_id).alias("id"), "distance_miles")
        return F.min(F.when(of_kind, found)).alias(kind)

    # one row per point, ring and ring rule, so the ring choice below sees a handful of rows
    banded = pairs.groupBy(
        "point_id", "lat", "lon", ring_of(F.col("distance_miles"), chosen).alias("_ring"), limited.alias("_limited")
    ).agg(
        closest("substation"), closest("transmission_line"), F.max(known).alias("_kv"),
        F.count(F.lit(1)).alias("_n"),
    )
    mine = Window.partitionBy("point_id")
    first = F.min(F.when(F.col("_limited"), F.col("_ring"))).over(mine)
    banded = banded.withColumn("_first", first).filter(~F.col("_limited") | (F.col("_ring") <= F.col("_first")))
    summary = banded.groupBy("lat", "lon").agg(
        F.min("substation").alias("_sub"), F.min("transmission_line").alias("_line"),
        F.max("_kv").alias("known_voltage_kv"), F.sum("_n").alias("asset_count"),
        *[F.sum(F.when(F.col("_ring") <= r, F.col("_n")).otherwise(F.lit(0))).alias(f"within_{r:g}_mile")
          for r in chosen],
    ).withColumns({
        "nearest_substation_miles": F.col("_sub.distance_miles"), "nearest_substation_id": F.col("_sub.id"),
        "nearest_line_miles": F.col("_line.distance_miles"), "nearest_line_id": F.col("_line.id"),
    }).drop("_sub", "_line")
    joined = sites.join(summary, ["lat", "lon"], "left")
    zeros = {f"within_{r:g}_mile": F.coalesce(f"within_{r:g}_mile", F.lit(0)) for r in chosen}
    return joined.withColumns({
        **zeros,
        "asset_count": F.coalesce("asset_count", F.lit(0)),
        "confidence_level": F.when(F.col("asset_count") > 0, F.lit("estimated")).otherwise(F.lit("unknown")),
    })
