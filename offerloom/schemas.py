"""Table schemas.  Only JSON-LD inside pages is dynamic; nothing else is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(), "DECIMAL(12,2)": T.DecimalType(12, 2), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _table(columns: str) -> T.StructType:
    """A schema from "name TYPE" pairs; needs no running session."""
    pairs = [column.split(" ") for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PAGES = _table("url STRING, html STRING, fetch_method STRING")
REQUESTS = _table(
    "job_id STRING, query STRING, radius_option STRING, include_unknown BOOLEAN, "
    "max_urls INT, time_budget_seconds INT"
)
GAZETTEER = _table(
    "raw_location STRING, city STRING, address STRING, lat DOUBLE, lon DOUBLE, country STRING"
)
CACHED_URLS = _table(
    "query_normalized STRING, provider STRING, url STRING, score DOUBLE, "
    "created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ"
)
CACHED_RESULTS = _table(
    "cache_key STRING, query_normalized STRING, domain STRING, source_url STRING, product_name STRING, "
    "price DECIMAL(12,2), currency STRING, size_text STRING, location_city STRING, location_address STRING, "
    "location_lat DOUBLE, location_lon DOUBLE, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ"
)
RESULTS = _table(
    "job_id STRING, product_name STRING, normalized_name STRING, domain STRING, source_url STRING, "
    "canonical_url STRING, price DECIMAL(12,2), price_token STRING, currency STRING, size_text STRING, "
    "location_city STRING, location_address STRING, location_lat DOUBLE, location_lon DOUBLE, "
    "distance_km DOUBLE, location_unknown BOOLEAN, extraction_method STRING, extractor STRING"
)
LINKS = _table("seed_domain STRING, pos BIGINT, url STRING, text STRING")
ROBOTS_RULES = _table("host STRING, agent STRING, rule_no INT, allow BOOLEAN, path STRING")
SITE_RULES = _table("host STRING, rule STRING, name_pattern STRING, price_pattern STRING, location STRING")

# Column widths of the stored results.
RESULT_WIDTHS = {
    "product_name": 500, "normalized_name": 500, "domain": 255, "currency": 10, "size_text": 180,
    "location_city": 120, "location_address": 500, "extraction_method": 40,
}
