"""Transverse Mercator between degrees and metres, as column expressions (Krueger's series to the third order)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid and the parameters of EPSG:2039.
A, FLATTENING = 6378137.0, 1 / 298.257222101
LAT0, LON0, SCALE, EAST0, NORTH0 = 31.734393611111113, 35.204516944444445, 1.0000067, 219529.584, 626907.39

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _meridian(lat: float) -> float:
    t = math.sinh(math.atanh(math.sin(lat)) - _E * math.atanh(_E * math.sin(lat)))
    xi = math.atan(t)
    return SCALE * _RADIUS * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA)))


_M0 = _meridian(math.radians(LAT0))


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y in EPSG:2039 of degrees on its own datum."""
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA):
        k = 2 * (j + 1)
        north = north + a * F.sin(k * xi) * F.cosh(k * eta)
        east = east + a * F.cos(k * xi) * F.sinh(k * eta)
    return EAST0 + SCALE * _RADIUS * east, NORTH0 - _M0 + SCALE * _RADIUS * north


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat of EPSG:2039 metres."""
    xi, eta = (y - NORTH0 + _M0) / (SCALE * _RADIUS), (x - EAST0) / (SCALE * _RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA):
        k = 2 * (j + 1)
        xi1 = xi1 - b * F.sin(k * xi) * F.cosh(k * eta)
        eta1 = eta1 - b * F.cos(k * xi) * F.sinh(k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA):
        phi = phi + d * F.sin(2 * (j + 1) * chi)
    return LON0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def looks_like_metres(min_x: float) -> bool:
    """Whether bounds are of the metric system rather than degrees."""
    return min_x > 100_000
