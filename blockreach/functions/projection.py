"""Geographic coordinates to UTM metres and back (WGS84, sixth-order Krueger series)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS84 ellipsoid and UTM constants.
_A = 6378137.0
_F = 1 / 298.257223563
_K0 = 0.9996
_FALSE_EASTING = 500_000.0
_FALSE_NORTHING = 10_000_000.0

_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a position."""
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def _central_meridian(epsg: Column) -> Column:
    return F.radians(((epsg % 100) - 1) * 6.0 - 177.0)


def _northing_offset(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(_FALSE_NORTHING)).otherwise(F.lit(0.0))


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """Struct ``x, y`` in metres for degrees in the zone ``epsg``."""
    dlon = F.radians(lon) - _central_meridian(epsg)
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - _E * F.atanh(_E * sin_lat))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, start=1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct(
        (_FALSE_EASTING + _K0 * _RADIUS * east).alias("x"),
        (_northing_offset(epsg) + _K0 * _RADIUS * north).alias("y"),
    )


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """Struct ``lon, lat`` in degrees for metres in the zone ``epsg``."""
    xi = (y - _northing_offset(epsg)) / (_K0 * _RADIUS)
    eta = (x - _FALSE_EASTING) / (_K0 * _RADIUS)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lon = _central_meridian(epsg) + F.atan2(F.sinh(eta0), F.cos(xi0))
    # Conformal to geodetic latitude by fixed-point iteration; five steps reach double precision.
    psi = F.atanh(F.sin(chi))
    sin_lat = F.sin(chi)
    for _ in range(5):
        sin_lat = F.tanh(psi + _E * F.atanh(_E * sin_lat))
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(F.asin(sin_lat)).alias("lat"))
