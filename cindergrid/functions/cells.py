"""Grid-cell keys, bounds and spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def cell_key(coord, resolution: float = 0.1) -> Column:
    """Integer cell index of a coordinate, halves to the even index."""
    return F.rint(_c(coord) / F.lit(resolution)).cast("long")


def cell_coord(key, resolution: float = 0.1) -> Column:
    return _c(key).cast("double") * F.lit(resolution)


def with_cell_keys(df, lat="latitude", lon="longitude", resolution: float = 0.1):
    """Add lat_key, lon_key and the rounded coordinates they stand for."""
    keyed = df.withColumns(
        {"lat_key": cell_key(lat, resolution), "lon_key": cell_key(lon, resolution)}
    )
    return keyed.withColumns(
        {
            "lat_rounded": cell_coord("lat_key", resolution),
            "lon_rounded": cell_coord("lon_key", resolution),
        }
    )


def in_box(lat, lon, bounds, epsilon: float = 0.0) -> Column:
    """Closed box test, bounds = (min_lat, min_lon, max_lat, max_lon)."""
    min_lat, min_lon, max_lat, max_lon = (float(b) for b in bounds)
    return _c(lat).between(min_lat - epsilon, max_lat + epsilon) & _c(lon).between(
        min_lon - epsilon, max_lon + epsilon
    )


def wrap_longitude(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2)
    h = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cell_area_kha(lat, resolution: float = 0.1) -> Column:
    """Area of a cell centred at a latitude on the mean sphere, thousand hectares."""
    radius_km = 6371.0088
    half = math.radians(resolution / 2.0)
    phi = F.radians(_c(lat))
    km2 = F.lit(radius_km * radius_km * math.radians(resolution)) * (
        F.sin(phi + half) - F.sin(phi - half)
    )
    return F.greatest(km2, F.lit(0.0)) / 10.0


def coordinate_encodings(lat, lon) -> dict[str, Column]:
    """Bounded encodings of a position, safe as model inputs."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    return {
        "lat_scaled": _c(lat) / 90.0,
        "lon_scaled": _c(lon) / 180.0,
        "lat_sin": F.sin(phi),
        "lat_cos": F.cos(phi),
        "lon_sin": F.sin(lam),
        "lon_cos": F.cos(lam),
    }


def square_offsets(radius: int) -> Column:
    """Array of (dlat, dlon) structs of the (2r+1) x (2r+1) neighbourhood."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    return F.flatten(
        F.transform(
            span,
            lambda a: F.transform(span, lambda b: F.struct(a.alias("dlat"), b.alias("dlon"))),
        )
    )


def spread_to_neighbours(df, radius: int, lat_key="lat_key", lon_key="lon_key"):
    """One copy of each row per neighbouring cell, keys shifted to that cell."""
    if radius <= 0:
        return df
    moved = df.withColumn("_o", F.explode(square_offsets(radius)))
    return moved.withColumns(
        {
            lat_key: F.col(lat_key) + F.col("_o.dlat"),
            lon_key: F.col(lon_key) + F.col("_o.dlon"),
        }
    ).drop("_o")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
