"""Geodesy and angles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
KNOT_MS = 0.514444
METRES_PER_DEGREE = 111_320.0

#: The WGS84 ellipsoid and UTM's scale and false easting and northing.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
UTM_K0, UTM_E0, UTM_N0_SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third order of the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on the sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def fold_angle(a: Column, b: Column) -> Column:
    """Angle between undirected axes, in [0, 90]."""
    return F.abs(F.pmod(a - b + 90.0, F.lit(180.0)) - 90.0)


def turn_deg(now: Column, before: Column) -> Column:
    """Size of the course change, in [0, 180]."""
    return F.abs(F.pmod(now - before + 180.0, F.lit(360.0)) - 180.0)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the point's UTM zone: 326zz north, 327zz south."""
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def utm_forward(lon: Column, lat: Column, zone: Column, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, dl = F.radians(lat), F.radians(lon) - _central_meridian(zone)
    c = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    u = atanh(s) - c * atanh(c * s)
    t = (F.exp(u) - F.exp(-u)) / 2
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_E0 + UTM_K0 * _RADIUS * e, (0.0 if north else UTM_N0_SOUTH) + UTM_K0 * _RADIUS * n


def utm_inverse(x: Column, y: Column, zone: Column, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi0 = (y - (0.0 if north else UTM_N0_SOUTH)) / (UTM_K0 * _RADIUS)
    eta0 = (x - UTM_E0) / (UTM_K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(_central_meridian(zone) + F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def grid_convergence(lon: Column, lat: Column, zone: Column) -> Column:
    """Clockwise angle from grid north to true north, in radians, by a step of about a metre to the north."""
    x0, y0 = utm_forward(lon, lat, zone)
    x1, y1 = utm_forward(lon, lat + 1e-5, zone)
    return F.atan2(x1 - x0, y1 - y0)


def to_grid_vector(east: Column, north: Column, convergence: Column, compat: bool = False) -> tuple[Column, Column]:
    """A true east and north vector along the grid's axes. compat keeps an older sign of the rotation, which turns
    vectors by twice the convergence the wrong way."""
    c, s = F.cos(convergence), F.sin(convergence)
    if compat:
        return east * c - north * s, east * s + north * c
    return east * c + north * s, north * c - east * s


def cell_area_km2(lat: Column, d_lon: float, d_lat: float) -> Column:
    return (METRES_PER_DEGREE / 1000) ** 2 * d_lon * d_lat * F.cos(F.radians(lat))


def point_in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a closed ring, by crossings. The ring is a literal, so the test stays in generated code."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        crossings = crossings + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def distance_to_ring_m(x: Column, y: Column, ring: list[tuple[float, float]], mid_lat: float) -> Column:
    """Distance to the ring's nearest edge, with degrees scaled to metres at mid_lat on either axis."""
    sx, sy = METRES_PER_DEGREE * math.cos(math.radians(mid_lat)), METRES_PER_DEGREE
    best = None
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
        dx, dy = (x2 - x1) * sx, (y2 - y1) * sy
        long2 = dx * dx + dy * dy
        px, py = (x - x1) * sx, (y - y1) * sy
        t = F.least(F.greatest((px * dx + py * dy) / long2, F.lit(0.0)), F.lit(1.0)) if long2 else F.lit(0.0)
        d = F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))
        best = d if best is None else F.least(best, d)
    return best


def wind_from_deg(u: Column, v: Column) -> Column:
    """Bearing that a wind of components toward east and north comes from, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
