"""Distance and radius columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, the centre all distances start from, and the
# radius in km behind each option ("All Romania" has none).
EARTH_RADIUS_KM = 6371
CENTER_LAT, CENTER_LON = 44.4268, 26.1025
RADIUS_KM = {"Bucuresti": 15, "50": 50, "100": 100, "200": 200}
EVERYWHERE = "All Romania"
RADIUS_OPTIONS = [*RADIUS_KM, EVERYWHERE]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km, two decimals; null if a coordinate is null."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.round(F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 2)


def distance_from_center(lat: Column, lon: Column) -> Column:
    return haversine_km(F.lit(CENTER_LAT), F.lit(CENTER_LON), lat, lon)


def within_radius(option: Column, include_unknown: Column, distance_km: Column, city: Column) -> Column:
    """Whether a row lies inside the radius option of its request."""
    city_plain = F.translate(F.lower(city), "ăâșț", "aast")
    limit = F.coalesce(*[F.when(option == name, F.lit(float(km))) for name, km in RADIUS_KM.items()])
    in_capital = (option == "Bucuresti") & F.coalesce(city_plain.contains("bucure"), F.lit(False))
    return (
        F.when(option == EVERYWHERE, F.lit(True))
        .when(in_capital, F.lit(True))
        .when(distance_km.isNull(), F.coalesce(include_unknown, F.lit(False)))
        .otherwise(F.coalesce(distance_km <= limit, F.lit(False)))
    )
