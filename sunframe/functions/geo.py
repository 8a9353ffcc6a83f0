"""Distances on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Great-circle distance in km between two points in degrees; ``cos1`` and ``cos2`` are the latitudes' cosines if known."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    cos1 = F.cos(F.radians(lat1)) if cos1 is None else cos1
    cos2 = F.cos(F.radians(lat2)) if cos2 is None else cos2
    chord = half_lat * half_lat + cos1 * cos2 * half_lon * half_lon
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_KM)


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance in degrees times 111 km."""
    return F.sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)) * KM_PER_DEGREE


def half_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A place as a vector of length 1/2: the squared distance of two such vectors is what ``haversine_km`` takes the root of."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b) / 2, F.cos(a) * F.sin(b) / 2, F.sin(a) / 2


def half_chord(radius_km: Column) -> Column:
    """The squared distance of half vectors that lie a radius apart; 1, the largest, beyond half the globe."""
    angle = F.least(F.greatest(radius_km, F.lit(0.0)) / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2))
    return F.sin(angle) * F.sin(angle)


def lat_reach(radius_km: Column) -> Column:
    """Degrees of latitude a radius can span (a hair more, so rounding never cuts a pair)."""
    return F.degrees(radius_km / EARTH_RADIUS_KM) + 1e-9


def lon_reach(lat: Column, radius_km: Column) -> Column:
    """Degrees of longitude a radius can span at a latitude; 180 once it touches a pole."""
    angle = radius_km / EARTH_RADIUS_KM
    touches_pole = F.abs(lat) + F.degrees(angle) >= 90
    return F.when(touches_pole, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat))))) + 1e-9)
