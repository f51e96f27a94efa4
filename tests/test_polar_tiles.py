"""Tiles near and beyond the poles."""

from pyspark.sql import functions as F

from skymosaic.functions import projections as P
from skymosaic.operators import coast

LAND = "array<struct<x:double,y:double>>"


def test_box_over_a_pole_has_no_tiles(spark):
    df = spark.createDataFrame([(1, 43.0, 89.983, 43.1, 90.1), (2, 43.013, 12.0, 43.123, 12.1)], "k int, west double, south double, east double, north double")
    n = {r.k: r.n for r in df.select("k", F.size(P.tiles_of(*[F.col(c) for c in ("west", "south", "east", "north")], 12)).alias("n")).collect()}
    assert n[1] == 0 and n[2] > 0


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def test_rings_at_and_beyond_a_pole_have_no_coast(spark):
    rows = [(box(43.0, 89.983, 43.1, 90.1), False), (box(43.0, 95.0, 43.1, 95.2), False), (box(43.0, -100.0, 43.1, -95.0), False)]
    assert coast.coast_tiles(spark.createDataFrame(rows, f"points {LAND}, hole boolean"), 12).count() == 0
    rows.append((box(43.0, 12.0, 43.1, 12.2), False))
    assert coast.coast_tiles(spark.createDataFrame(rows, f"points {LAND}, hole boolean"), 12).count() > 0


def test_share_of_small_tiles_keeps_its_digits(spark):
    west, south, east, north = 45.395508, 89.98000123, 45.483398, 89.98003456
    land = spark.createDataFrame([(box(45.4001, 89.9, 46.0, 89.98001777), False)], f"points {LAND}, hole boolean")
    tiles = spark.createDataFrame([(west, south, east, north)], "west double, south double, east double, north double")
    got = coast.land_share(tiles, land).first().land_ratio
    want = (east - 45.4001) * (89.98001777 - south) / ((east - west) * (north - south))
    assert abs(got - want) < 1e-11
