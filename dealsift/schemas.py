"""Record schemas: captured hits, detail fields, listings and their history."""

from pyspark.sql import DataFrame, functions as F

RAW_HIT = {
    "source_name": "string", "source_url": "string", "original_title": "string", "original_description": "string",
    "category": "string", "source_type": "string", "domain": "string", "query": "string", "region_name": "string",
    "state": "string", "discovery_mode": "string", "raw_data": "map<string,string>", "fetched_at": "timestamp",
}

DETAIL = {
    "title": "string", "description": "string", "source_listing_id": "string", "lot_number": "string",
    "seller_name": "string", "total_price": "double", "current_price": "double", "quantity": "bigint",
    "bid_count": "bigint", "buyer_premium": "string", "location_city": "string", "location_state": "string",
    "zip_code": "string", "pickup_only": "boolean", "shipping_available": "boolean", "listing_status": "string",
    "listing_status_reason": "string", "end_time_utc": "timestamp", "auction_end_time": "timestamp",
    "end_time_verification": "string", "end_time_raw": "string", "end_time_timezone_raw": "string",
    "timezone_needs_verification": "boolean", "countdown_raw_text": "string", "countdown_captured_at": "timestamp",
    "calculated_end_time": "timestamp", "calculated_timezone": "string", "calculation_confidence": "string",
    "time_remaining": "string", "needs_manual_review": "boolean", "unavailable_reason": "string",
    "status_check_attempts": "bigint", "status_check_result": "string", "status_check_error": "string",
}

# what a hit may carry besides the required columns
HARDWARE_HIT_EXTRAS = {
    "page_type": "string", "classification_reason": "string", "source_listing_id": "string",
    "seller_name": "string", "domain": "string", "detail_checked_at": "timestamp",
}
SITE_HIT_EXTRAS = {"state": "string", "source_type": "string", "domain": "string", "region_name": "string"}
SUPPLIER_HIT_EXTRAS = {"state": "string", "discovery_mode": "string", "domain": "string", "region_name": "string"}

OBSERVATION = {
    "event_id": "bigint", "opportunity_key": "string", "observed_at": "timestamp", "total_price_usd": "bigint",
    "quantity": "int", "listing_status": "string",
}

POWER_ASSET = {
    "asset_id": "string", "asset_type": "string", "asset_name": "string", "lat": "double", "lon": "double",
    "vertices": "array<struct<lat:double,lon:double>>", "voltage_kv": "double", "owner": "string",
    "operator": "string", "status": "string", "source_name": "string",
}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schema.items())


# columns that may be null in stored rows and the value they are read back as
HARDWARE_DEFAULTS = {
    "recommendation_reasons": "array<string>", "risk_flags": "array<string>",
    "change_types": "array<string>", "score_reasons": "array<string>",
    "component_details": "map<string,string>", "raw_data_json": "map<string,string>",
    "automated_result": "map<string,string>", "manual_result": "map<string,string>",
}
SUPPLIER_DEFAULTS = {
    "equipment_types": "array<string>", "score_reasons": "array<string>",
    "quality_flags": "array<string>", "supplier_types": "array<string>", "certifications": "array<string>",
    "raw_data_json": "map<string,string>",
}


def with_missing(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add the columns of the schema that the frame lacks, as nulls."""
    have = set(df.columns)
    missing = {name: F.lit(None).cast(kind) for name, kind in schema.items() if name not in have}
    return df.withColumns(missing) if missing else df


def legacy_defaults(df: DataFrame, kind: str = "hardware") -> DataFrame:
    """Replace nulls of older rows by empty arrays and maps and by the status defaults."""
    table = HARDWARE_DEFAULTS if kind == "hardware" else SUPPLIER_DEFAULTS
    fixes = {}
    for name, kind_of in table.items():
        if name in df.columns:
            empty = F.array() if kind_of.startswith("array") else F.create_map()
            fixes[name] = F.coalesce(F.col(name), empty.cast(kind_of))
    if kind == "hardware":
        if "final_status" in df.columns:
            status = F.nullif(F.col("listing_status"), F.lit("")) if "listing_status" in df.columns else F.lit(None)
            fixes["final_status"] = F.coalesce(F.col("final_status"), status, F.lit("unknown"))
        for name in ("cost_confidence", "quantity_status"):
            if name in df.columns:
                fixes[name] = F.coalesce(F.col(name), F.lit("unknown"))
    return df.withColumns(fixes)
