"""Coordinates as column expressions: affine map, transverse Mercator, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fitted map of local x, y to longitude and latitude.
AFFINE = {"a": -4.25994981e-06, "b": -8.74119271e-06, "c": 8.11700876e-06, "d": -3.95042166e-06, "e": 1.14014210e02, "f": 2.26438070e01}

# WGS 84 and the universal transverse Mercator grid.
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
RADIUS = _K0 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
ECC = 2 * math.sqrt(_N) / (1 + _N)


def meridian(zone: int) -> float:
    """Central meridian of a UTM zone, in degrees."""
    return 6.0 * zone - 183.0


def affine(x: Column, y: Column, p: dict[str, float] = AFFINE) -> tuple[Column, Column]:
    """Longitude and latitude of local coordinates."""
    return p["a"] * x + p["b"] * y + p["e"], p["c"] * x + p["d"] * y + p["f"]


def utm_forward(lon: Column, lat: Column, zone: int = 50) -> tuple[Column, Column]:
    """Easting and northing, northern hemisphere, in metres, by Krueger's series to the third order."""
    phi, lam = F.radians(lat), F.radians(lon - meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + RADIUS * east, RADIUS * north


def utm_inverse(easting: Column, northing: Column, zone: int = 50) -> tuple[Column, Column]:
    """Longitude and latitude of a point of the grid."""
    xi, eta = northing / RADIUS, (easting - _E0) / RADIUS
    x, e = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + meridian(zone), F.degrees(phi)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2)) + F.pow(y1 - y2, F.lit(2)))
