"""Distances, angles and units on a sphere, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the sphere's radius in metres.
EARTH_RADIUS = 6371e3
#: Metres of one unit of distance.
UNITS = {"m": 1.0, "km": 1000.0}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if not isinstance(c, Column) else c


def haversine(lon0, lat0, lon1, lat1, radius: float = EARTH_RADIUS, units: str = "m") -> Column:
    """Great-circle distance between points in degrees."""
    lon0, lat0, lon1, lat1 = (F.radians(_col(c)) for c in (lon0, lat0, lon1, lat1))
    h = F.pow(F.sin((lat1 - lat0) / 2), F.lit(2)) + F.cos(lat0) * F.cos(lat1) * F.pow(F.sin((lon1 - lon0) / 2), F.lit(2))
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * (2 * radius / UNITS[units])


def bearing(lon0, lat0, lon1, lat1) -> Column:
    """Angle of the way from one point to the other, in degrees: east 0, north 90, south -90, west 180."""
    lon0, lat0, lon1, lat1 = (F.radians(_col(c)) for c in (lon0, lat0, lon1, lat1))
    north = F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(lon1 - lon0)
    east = F.sin(lon1 - lon0) * F.cos(lat1)
    return F.degrees(F.atan2(north, east))


def deg2m(deg, lat=None, radius: float = EARTH_RADIUS) -> Column:
    """Degrees as metres along a meridian, or with ``lat`` along that parallel."""
    out = _col(deg) * (math.pi * radius / 180)
    return out if lat is None else out * F.cos(F.radians(_col(lat)))


def m2deg(met, lat=None, radius: float = EARTH_RADIUS) -> Column:
    """Metres as degrees, the inverse of :func:`deg2m`."""
    out = _col(met) * (180 / (math.pi * radius))
    return out if lat is None else out / F.cos(F.radians(_col(lat)))
