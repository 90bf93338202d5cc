"""Power assets from GeoJSON features and map-element JSON."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dealsift.functions import amount, geo

_FEATURE = "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
_ELEMENT = ("struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,"
            "geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>")


def read_features(spark: SparkSession, path: str, per_line: bool = True) -> DataFrame:
    """GeoJSON text: one feature per line (splittable), or whole collections, one per file."""
    if per_line:
        return spark.read.text(path).withColumnRenamed("value", "feature")
    collections = spark.read.text(path, wholetext=True).withColumnRenamed("value", "collection")
    return features_of(collections, "collection")


def features_of(collections: DataFrame, column: str) -> DataFrame:
    """One row per feature of a FeatureCollection text, as JSON text."""
    keep = [c for c in collections.columns if c != column]
    parsed = F.from_json(column, "features array<string>")
    return collections.select(*keep, F.posexplode(parsed["features"]).alias("feature_pos", "feature"))


def geojson_lines_scan(features: DataFrame, column: str = "feature") -> DataFrame:
    """One transmission line per LineString or part of a MultiLineString; other shapes are dropped."""
    df = features.withColumn("_f", F.from_json(column, _FEATURE))
    kind, raw = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>"))).when(
        kind == "MultiLineString", F.from_json(raw, "array<array<array<double>>>"))
    df = df.withColumn("_props", F.coalesce(F.col("_f.properties"), F.create_map().cast("map<string,string>")))

    def prop(*names: str, skip_zero: bool = False) -> Column:
        values = [F.nullif(F.try_element_at("_props", F.lit(n)), F.lit("")) for n in names]
        if skip_zero:
            values = [F.when(~v.isin("0", "0.0", "false"), v) for v in values]
        return F.coalesce(*values)

    keep = [c for c in features.columns if c != column]
    df = df.select(*keep, "_props", F.posexplode(lines).alias("part", "_line"))
    vertices = F.transform("_line", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    df = df.withColumn("vertices", vertices).withColumn("_center", geo.polyline_center(F.col("vertices")))
    return df.select(
        *keep, "part", F.lit("transmission_line").alias("asset_type"), prop("name", "LINE_NAME").alias("asset_name"),
        F.col("_center.lat").alias("lat"), F.col("_center.lon").alias("lon"), "vertices",
        prop("voltage_kv", "VOLTAGE", "KV", skip_zero=True).try_cast("double").alias("voltage_kv"),
        prop("owner", "OWNER").alias("owner"), prop("status", "STATUS").alias("status"),
        F.coalesce(prop("source_name"), F.lit("Local GeoJSON transmission dataset")).alias("source_name"))


def osm_elements_scan(documents: DataFrame, column: str = "elements") -> DataFrame:
    """Typed assets from map-element JSON; elements that are no power asset are dropped."""
    keep = [c for c in documents.columns if c != column]
    df = documents.select(*keep, F.explode(F.from_json(column, f"array<{_ELEMENT}>")).alias("_e"))
    power = F.try_element_at("_e.tags", F.lit("power"))
    kind = (
        F.when(power.isin("line", "minor_line"), F.lit("transmission_line"))
        .when(power.isin("tower", "pole"), F.lit("tower")).when(power == "plant", F.lit("plant"))
        .when(power == "substation", F.lit("substation"))
    )
    vertices = F.filter(F.coalesce("_e.geometry", F.array().cast("array<struct<lat:double,lon:double>>")),
                        lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    df = df.withColumns({"asset_type": kind, "vertices": vertices}).filter(F.col("asset_type").isNotNull())
    center = geo.polyline_center(F.col("vertices"))
    own = F.col("_e.lat").isNotNull() & F.col("_e.lon").isNotNull()
    drawn = F.size("vertices") > 0

    def place(field: str) -> Column:
        return F.when(drawn, center[field]).when(own, F.col(f"_e.{field}")).otherwise(F.col(f"_e.center.{field}"))

    def tag(name: str) -> Column:
        return F.try_element_at("_e.tags", F.lit(name))

    return df.select(
        *keep, F.concat_ws("/", "_e.type", "_e.id").alias("asset_id"), "asset_type", tag("name").alias("asset_name"),
        place("lat").alias("lat"), place("lon").alias("lon"), F.when(drawn, F.col("vertices")).alias("vertices"),
        amount.osm_voltage_kv(tag("voltage")).alias("voltage_kv"), tag("owner").alias("owner"),
        tag("operator").alias("operator"), tag("status").alias("status"))
