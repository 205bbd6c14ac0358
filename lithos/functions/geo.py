"""Distances, felt radii and levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.policies import EARTH_KM, EPSILON


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def chebyshev(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The larger of the two differences, in degrees."""
    return F.greatest(F.abs(lat1 - lat2), F.abs(lon1 - lon2))


def felt_radius_km(magnitude: Column, depth_km: Column) -> Column:
    """Surface radius in which a quake is felt; 0 if its felt sphere stays below the ground."""
    r = F.pow(F.lit(10.0), magnitude * 0.5 - 1)
    h = F.greatest(F.coalesce(depth_km, F.lit(0.0)), F.lit(0.0))
    return F.when(h >= r, F.lit(0.0)).otherwise(F.sqrt(F.greatest(r * r - h * h, F.lit(0.0))))


def quake_level(magnitude: Column, depth_km: Column, distance_km: Column, felt_km: Column | None = None) -> Column:
    """Level 1 to 4 of a place at a distance; bounds belong to the higher level. ``felt_km`` is the felt radius if it is known already."""
    m, d = magnitude + EPSILON, distance_km - EPSILON
    inside = d <= (felt_radius_km(magnitude, depth_km) if felt_km is None else felt_km)
    return F.when((m >= 6) & (d <= 100), 4).when((inside & (m >= 5)) | ((m >= 4.5) & (d <= 50)), 3).when(inside, 2).otherwise(1)


def query_radius_km(magnitude: Column, depth_km: Column, most: float = 1000.0) -> Column:
    """How far out places must be looked at."""
    near = F.when(magnitude + EPSILON >= 6, 100.0).when(magnitude + EPSILON >= 4.5, 50.0).otherwise(0.0)
    return F.least(F.greatest(felt_radius_km(magnitude, depth_km), near), F.lit(most))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """In (west, south, east, north), edges included."""
    west, south, east, north = box
    return lat.between(south, north) & lon.between(west, east)


def round_half_up(x: Column, digits: int) -> Column:
    """Rounded with halves going up, the same in every engine; never -0."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k
