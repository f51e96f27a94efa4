"""Map projections as Column expressions: transverse Mercator zones on WGS84, and web map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

# WGS84 ellipsoid and the scale of a UTM zone's central meridian.
RADIUS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

_n = FLATTENING / (2 - FLATTENING)
_e = math.sqrt(FLATTENING * (2 - FLATTENING))
_A = RADIUS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Krueger's series to the sixth order of the third flattening
FORWARD = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288 + 7891 * _n**6 / 37800,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630 - 1983433 * _n**6 / 1935360,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880 + 167603 * _n**6 / 181440,
    49561 * _n**4 / 161280 - 179 * _n**5 / 168 + 6601661 * _n**6 / 7257600,
    34729 * _n**5 / 80640 - 3418889 * _n**6 / 1995840,
    212378941 * _n**6 / 319334400,
)
BACKWARD = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360 - 81 * _n**5 / 512 + 96199 * _n**6 / 604800,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440 + 46 * _n**5 / 105 - 1118711 * _n**6 / 3870720,
    17 * _n**3 / 480 - 37 * _n**4 / 840 - 209 * _n**5 / 4480 + 5569 * _n**6 / 90720,
    4397 * _n**4 / 161280 - 11 * _n**5 / 504 - 830251 * _n**6 / 7257600,
    4583 * _n**5 / 161280 - 108847 * _n**6 / 3991680,
    20648693 * _n**6 / 638668800,
)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = True) -> Column:
    """struct<x,y> in metres."""
    lam = F.radians(lon - (6 * zone - 183))
    tangent = F.sinh(F.atanh(F.sin(F.radians(lat))) - _e * F.atanh(_e * F.sin(F.radians(lat))))

    def angles(a: Column) -> Column:
        return F.struct(F.atan2(a["t"], F.cos(a["lam"])).alias("xi"), F.atanh(F.sin(a["lam"]) / F.sqrt(1 + a["t"] * a["t"])).alias("eta"))

    def metres(a: Column) -> Column:
        xi, eta = a["xi"], a["eta"]
        x = eta + sum(c * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(FORWARD))
        y = xi + sum(c * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(FORWARD))
        return F.struct((EAST + SCALE * _A * x).alias("x"), ((SOUTH if south else 0.0) + SCALE * _A * y).alias("y"))

    return let(let(F.struct(tangent.alias("t"), lam.alias("lam")), angles), metres)


def from_utm(x: Column, y: Column, zone: int, south: bool = True) -> Column:
    """struct<x,y> as longitude and latitude."""
    scaled = F.struct(((y - (SOUTH if south else 0.0)) / (SCALE * _A)).alias("xi"), ((x - EAST) / (SCALE * _A)).alias("eta"))

    def sphere(a: Column) -> Column:
        xi, eta = a["xi"], a["eta"]
        u = xi - sum(b * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, b in enumerate(BACKWARD))
        v = eta - sum(b * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, b in enumerate(BACKWARD))
        return F.struct(u.alias("u"), v.alias("v"))

    def degrees(a: Column) -> Column:
        u, v = a["u"], a["v"]
        goal = F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u))  # tangent of the conformal latitude
        # geographic latitude from the conformal one: a fixed point that gains five digits a step
        step = lambda g, s: let(F.sinh(F.asinh(g) + _e * F.atanh(_e * s)), lambda t: t / F.sqrt(1 + t * t))
        lat = let(goal, lambda g: F.aggregate(F.array_repeat(F.lit(0), 4), g / F.sqrt(1 + g * g), lambda s, _: step(g, s)))
        return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6 * zone - 183)).alias("x"), F.degrees(F.asin(lat)).alias("y"))

    return let(let(scaled, sphere), degrees)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * 2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * 2**zoom)


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    """struct<west,south,east,north>."""
    lon = lambda c: c / 2**zoom * 360.0 - 180.0
    lat = lambda c: F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * c / 2**zoom))))
    return F.struct(lon(x).alias("west"), lat(y + 1).alias("south"), lon(x + 1).alias("east"), lat(y).alias("north"))


def _upwards(first: Column, last: Column) -> Column:
    """A sequence that is empty where it would run backwards."""
    return F.filter(F.sequence(first, F.greatest(first, last)), lambda v: v <= last)


def tiles_of(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """array<struct<x,y>> of the tiles that meet a box; none where its north would lie in a row below its south, as with a pole between them."""
    xs = _upwards(tile_x(west, zoom), tile_x(east - 1e-9, zoom))
    ys = _upwards(tile_y(north, zoom), tile_y(south + 1e-9, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
