"""Repaired rings against a raster, and their own validity."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymosaic.functions import geometry as G
from skymosaic.functions.repair import repair, repaired


def winding(ring, x, y):
    """Of every place of a grid, by the sides that pass to its right."""
    out = np.zeros(x.shape, int)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        side = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
        out += ((y0 <= y) & (y1 > y) & (side > 0)).astype(int) - ((y1 <= y) & (y0 > y) & (side < 0)).astype(int)
    return out


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def crossed(rng, n):
    kind = rng.random()
    if kind < 0.5:
        return [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(n)]
    if kind < 0.8:  # corners on a coarse grid: touching and overlapping sides
        return [(10.0 * rng.randint(0, 9), 10.0 * rng.randint(0, 9)) for _ in range(n)]
    k = rng.choice([2, 3])
    return [(50 + 45 * math.cos(2 * math.pi * k * i / n + 0.1), 50 + 45 * math.sin(2 * math.pi * k * i / n + 0.1)) for i in range(n)]


def test_area_of_1000_crossed_rings():
    rng = random.Random(1)
    x, y = np.meshgrid(np.arange(0, 100, 0.5) + 0.2503, np.arange(0, 100, 0.5) + 0.2507)
    for k in range(1000):
        ring = crossed(rng, rng.randint(3, 12))
        w = winding(ring, x, y)
        for rule, flat in (("odd", w % 2 != 0), ("nonzero", w != 0)):
            if rule == "nonzero" and k % 4:
                continue
            pieces = repaired(ring, rule)
            assert abs(sum(map(signed, pieces)) - flat.sum() / 4) < 60, (k, rule, ring)
            if not k % 20:
                again = np.zeros(x.shape, int)
                for p in pieces:
                    again += winding(p, x, y)
                assert (again.astype(bool) != flat).sum() <= 60


def test_pieces_are_valid(spark):
    rng = random.Random(2)
    rings = [crossed(rng, rng.randint(3, 10)) for _ in range(150)] + [[(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, r array<struct<x:double,y:double>>")
    pieces = df.select("i", F.posexplode(repair(F.col("r"))).alias("k", "p")).select("i", "k", "p", G.is_simple(F.col("p")).alias("ok")).collect()
    assert all(r.ok for r in pieces if abs(signed([tuple(p) for p in r.p])) > 1e-6)
    tie = [r for r in pieces if r.i == 150]
    assert len(tie) == 2 and all(signed([tuple(p) for p in r.p]) == pytest.approx(25) for r in tie)


def test_rings_that_need_no_repair():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    (same,) = repaired(square)
    assert sorted(same) == sorted(square) and signed(same) == 16
    (turned,) = repaired(square[::-1] + square[-1:])
    assert signed(turned) == 16
    assert repaired([]) == repaired([(1.0, 1.0)] * 5) == repaired([(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)]) == repaired([(0.0, math.nan)] * 4) == []
    spike = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 9.0), (4.0, 4.0), (0.0, 4.0)]
    assert sum(map(signed, repaired(spike))) == pytest.approx(16)


def test_holes_and_doubled_parts():
    twice = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0), (3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]
    assert sum(map(signed, repaired(twice))) == pytest.approx(72)  # the inside counts twice, so it is a hole
    assert sorted(round(signed(r)) for r in repaired(twice)) in ([-9, 81], [72])
    assert sum(map(signed, repaired(twice, "nonzero"))) == pytest.approx(81)
    star = [(50 + 40 * math.sin(4 * math.pi * k / 5), 50 + 40 * math.cos(4 * math.pi * k / 5)) for k in range(5)]
    assert len(repaired(star)) == 5 and len(repaired(star, "nonzero")) == 1
