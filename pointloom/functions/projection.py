"""Lambert-93 coordinates (EPSG 2154) as geographic (4979) and geocentric (4978) ones, and back, as column arithmetic. Heights are ellipsoidal and stay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid GRS 80 and the projection's published constants. Fixed values.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257222101
LON0, LAT0, LAT1, LAT2 = 3.0, 46.5, 44.0, 49.0
FALSE_EAST, FALSE_NORTH = 700_000.0, 6_600_000.0

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _grand(lat: float) -> float:
    return SEMI_MAJOR / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _isometric(lat: float) -> float:
    return math.log(math.tan(math.pi / 4 + lat / 2) * ((1 - _E * math.sin(lat)) / (1 + _E * math.sin(lat))) ** (_E / 2))


def _cone() -> tuple[float, float, float]:
    """(exponent, constant, northing of the pole) of the cone through the two parallels."""
    p0, p1, p2 = (math.radians(v) for v in (LAT0, LAT1, LAT2))
    n = math.log(_grand(p2) * math.cos(p2) / (_grand(p1) * math.cos(p1))) / (_isometric(p1) - _isometric(p2))
    c = _grand(p1) * math.cos(p1) / n * math.exp(n * _isometric(p1))
    return n, c, FALSE_NORTH + c * math.exp(-n * _isometric(p0))


_N, _C, _POLE = _cone()


def geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees. The latitude is found by six steps, each of which leaves about a 150th of the error."""
    dx, dy = x - FALSE_EAST, F.lit(_POLE) - y
    lon = F.lit(LON0) + F.degrees(F.atan(dx / dy) / _N)
    iso = -F.log(F.sqrt(dx * dx + dy * dy) / _C) / _N
    step = lambda lat, _: 2 * F.atan(F.pow((1 + _E * F.sin(lat)) / (1 - _E * F.sin(lat)), F.lit(_E / 2)) * F.exp(iso)) - math.pi / 2
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), 2 * F.atan(F.exp(iso)) - math.pi / 2, step)
    return lon, F.degrees(lat)


def geocentric(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    l, p = F.radians(lon), F.radians(lat)
    n = F.lit(SEMI_MAJOR) / F.sqrt(1 - _E2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(l), (n + height) * F.cos(p) * F.sin(l), (n * (1 - _E2) + height) * F.sin(p)


def lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) of degrees, the inverse of ``geographic``."""
    p = F.radians(lat)
    iso = F.log(F.tan(math.pi / 4 + p / 2) * F.pow((1 - _E * F.sin(p)) / (1 + _E * F.sin(p)), F.lit(_E / 2)))
    r, g = F.lit(_C) * F.exp(-_N * iso), F.lit(_N) * F.radians(lon - LON0)
    return F.lit(FALSE_EAST) + r * F.sin(g), F.lit(_POLE) - r * F.cos(g)


def region(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column) -> Column:
    """A region of a tile tree: west, south, east and north in radians, then the least and greatest height."""
    return F.array(*[F.radians(v) for v in (west, south, east, north)], low, high)
