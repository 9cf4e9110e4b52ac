"""Places: gazetteer lookups and radius filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.functions.geo import distance_from_center, within_radius
from offerloom.plans.joins import lookup_join


def clean_location(c: Column) -> Column:
    """Gazetteer key of a location text; null if blank."""
    return T.non_empty(F.left(T.collapse_spaces(c), F.lit(500)))


def geocode_join(df: DataFrame, gazetteer: DataFrame, location: str = "location_text") -> DataFrame:
    """Attach city, address, coordinates and country of a location text, if known."""
    keyed = df.withColumn("_key", clean_location(F.col(location)))
    places = gazetteer.select(
        F.col("raw_location").alias("_key"), "city", "address", "lat", "lon", "country"
    )
    return lookup_join(keyed, places, ["_key"], "left", costly=True).drop("_key")


def geocode_misses(df: DataFrame, gazetteer: DataFrame, location: str = "location_text") -> DataFrame:
    """Distinct location texts the gazetteer does not know, to be resolved elsewhere."""
    wanted = df.select(clean_location(F.col(location)).alias("raw_location")).filter(
        F.col("raw_location").isNotNull()
    )
    return wanted.distinct().join(gazetteer.select("raw_location"), "raw_location", "left_anti")


def with_distance(df: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "distance_km") -> DataFrame:
    """Distance from the centre in km; null without both coordinates."""
    return df.withColumn(out, distance_from_center(F.col(lat), F.col(lon)))


def radius_filter(
    df: DataFrame,
    city: str = "location_city",
    distance: str = "distance_km",
    option: str = "radius_option",
    include_unknown: str = "include_unknown",
) -> DataFrame:
    """Rows inside the radius option their request asked for."""
    return df.filter(within_radius(F.col(option), F.col(include_unknown), F.col(distance), F.col(city)))
