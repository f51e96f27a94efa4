"""Geometry columns against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymosaic.functions import geometry as G
from skymosaic.functions import projections as P

POLYGON = "array<struct<x:double,y:double>>"


def polygons(spark, *rows):
    names = [f"p{k}" for k in range(len(rows[0]))]
    return spark.createDataFrame([tuple([(float(x), float(y)) for x, y in p] for p in r) for r in rows], ", ".join(f"{n} {POLYGON}" for n in names))


def rotated(cx, cy, w, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + c * x - s * y, cy + s * x + c * y) for x, y in ((-w, -h), (w, -h), (w, h), (-w, h))]


def inside(points, x, y):
    """Even-odd rule on a grid."""
    hit = np.zeros(x.shape, bool)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
        hit ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0 + 1e-300) + x0)
    return hit


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


@pytest.mark.parametrize(
    ("points", "expected"),
    [(SQUARE, 100.0), ([(5, 5), (15, 5), (15, 15), (5, 15)], 25.0), ([(10, 0), (20, 0), (20, 10), (10, 10)], 0.0), ([(10, 10), (12, 10), (12, 12), (10, 12)], 0.0), ([(20, 20), (21, 20), (21, 21), (20, 21)], 0.0), ([(3, 3)] * 4, 0.0), ([(-5, 4), (15, 4), (15, 5), (-5, 5)], 10.0)],
)
def test_visible_area(spark, points, expected):
    box = [F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]
    assert polygons(spark, (points,)).select(G.area(G.clip_to_box(F.col("p0"), *box))).first()[0] == pytest.approx(expected)


def test_iou_properties(spark):
    rng = np.random.default_rng(3)
    boxes = [rotated(*rng.uniform(0, 6, 2), *rng.uniform(1, 4, 2), rng.uniform(0, 3)) for _ in range(40)]
    df = polygons(spark, *zip(boxes, boxes[1:] + boxes[:1]))
    rows = df.select(G.convex_iou(F.col("p0"), F.col("p1")).alias("a"), G.convex_iou(F.col("p1"), F.col("p0")).alias("b"), G.convex_iou(F.col("p0"), F.col("p0")).alias("c"), G.polygon_iou(F.col("p0"), F.col("p1")).alias("d")).collect()
    for r in rows:
        assert r.a == pytest.approx(r.b, abs=1e-9) and r.c == pytest.approx(1) and r.d == pytest.approx(r.a, abs=1e-9) and 0 <= r.a <= 1


def test_polygon_iou_of_concave_shapes(spark):
    ell = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
    other = [(1, 1), (5, 1), (5, 5), (3, 3), (1, 5)]
    got = polygons(spark, (ell, other)).select(G.polygon_iou(F.col("p0"), F.col("p1"))).first()[0]
    x, y = np.meshgrid(np.arange(0, 6, 0.01) + 0.005, np.arange(0, 6, 0.01) + 0.005)
    a, b = inside(ell, x, y), inside(other, x, y)
    assert got == pytest.approx((a & b).sum() / (a | b).sum(), abs=2e-3)


def test_simple_polygons(spark):
    rows = polygons(spark, (SQUARE,), ([(0, 0), (10, 10), (10, 0), (0, 10)],), ([(0, 0), (1, 1)],), ([(0, 0), (5, 0), (10, 0)],)).select(G.is_simple(F.col("p0"))).collect()
    assert [r[0] for r in rows] == [True, False, False, False]


def test_min_rotated_rectangle(spark):
    rng = np.random.default_rng(5)
    clouds = [rng.uniform(0, 10, (7, 2)) for _ in range(5)]
    got = [r[0] for r in polygons(spark, *[(c.tolist(),) for c in clouds]).select(G.area(G.min_rotated_rectangle(F.col("p0")))).collect()]
    for c, a in zip(clouds, got):
        best = min(np.ptp(c @ [math.cos(t), math.sin(t)]) * np.ptp(c @ [-math.sin(t), math.cos(t)]) for t in np.arange(0, math.pi / 2, 1e-4))
        assert a == pytest.approx(best, rel=1e-3) and a <= best + 1e-9


def test_min_side(spark):
    g = polygons(spark, ([(0, 0), (20, 0), (20, 1), (0, 1)],), ([(3, 3)] * 4,)).select(G.enforce_min_side(F.col("p0"), 4.0).alias("g")).select(G.long_side(F.col("g")), G.short_side(F.col("g"))).collect()
    assert [tuple(r) for r in g] == [(20.0, 4.0), (4.0, 4.0)]


def test_rings_and_centroid(spark):
    r = polygons(spark, (SQUARE,)).select(F.size(G.closed(F.col("p0"))), F.size(G.closed(G.closed(F.col("p0")))), F.size(G.opened(G.closed(F.col("p0")))), G.centroid(F.col("p0"))).first()
    assert tuple(r[:3]) == (5, 5, 4) and tuple(r[3]) == (5.0, 5.0)


def test_affine(spark):
    t = G.affine(2.0, 0.5, 100.0, -0.25, -3.0, 50.0)
    r = polygons(spark, (SQUARE,)).select(G.invert_affine(t, G.apply_affine(t, F.col("p0"))), G.affine_to_text(t), G.invert_affine(G.affine(0, 0, 1, 0, 0, 1), F.col("p0"))).first()
    assert [v for p in r[0] for v in (p.x, p.y)] == pytest.approx([float(v) for p in SQUARE for v in p]) and r[1].startswith("2.0,0.5,100.0") and r[2] is None


def test_line_meets_box(spark):
    box = [F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]
    lines = ([(-5, 5), (15, 5)],), ([(-5, 12), (15, 12)],), ([(1, 1), (2, 2)],), ([(-1, -1)],)
    assert [r[0] for r in polygons(spark, *lines).select(G.line_meets_box(F.col("p0"), *box)).collect()] == [True, False, True, False]


def test_utm_round_trip(spark):
    # known place: on the central meridian of zone 39 the easting is 500 km
    df = spark.createDataFrame([(51.0, -20.0), (47.5, -18.9), (53.2, -12.1)], "lon double, lat double")
    u = df.select("*", P.to_utm(F.col("lon"), F.col("lat"), 39).alias("u")).select("*", P.from_utm(F.col("u.x"), F.col("u.y"), 39).alias("b")).collect()
    assert u[0].u.x == pytest.approx(500000) and u[0].u.y == pytest.approx(10_000_000 - 0.9996 * 2212366.254, abs=0.05)
    for r in u:
        assert (r.b.x, r.b.y) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_web_tiles(spark):
    r = spark.range(1).select(P.tile_bounds(F.lit(0), F.lit(0), 0)).first()
    assert r[0].north == pytest.approx(85.0511287798) and (r[0].west, r[0].east) == (-180.0, 180.0)
    b = spark.range(1).select(P.tile_bounds(P.tile_x(F.lit(47.5), 15), P.tile_y(F.lit(-18.9), 15), 15).alias("b")).first().b
    assert b.west <= 47.5 < b.east and b.south < -18.9 <= b.north
