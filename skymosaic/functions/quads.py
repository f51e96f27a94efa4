"""Geometry of quadrilaterals as plain arithmetic: four corners are written out, so Spark compiles what lambdas would interpret.

`points` is an array of exactly four struct<x,y>; results equal those of `geometry`, which takes any number of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(points: Column) -> list[tuple[Column, Column]]:
    return [(points[k]["x"], points[k]["y"]) for k in range(4)]


def crosses(points: Column) -> list[Column]:
    """Terms of the shoelace sum."""
    p = corners(points)
    return [p[k][0] * p[(k + 1) % 4][1] - p[(k + 1) % 4][0] * p[k][1] for k in range(4)]


def signed_area(points: Column) -> Column:
    a, b, c, d = crosses(points)
    return (a + b + c + d) / 2


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


def side_lengths(points: Column) -> list[Column]:
    p = corners(points)
    square = lambda c: c * c
    return [F.sqrt(square(p[(k + 1) % 4][0] - p[k][0]) + square(p[(k + 1) % 4][1] - p[k][1])) for k in range(4)]


def long_side(points: Column) -> Column:
    return F.greatest(*side_lengths(points))


def short_side(points: Column) -> Column:
    return F.least(*side_lengths(points))


def bounds(points: Column) -> Column:
    """struct<x0,y0,x1,y1>."""
    xs, ys = zip(*corners(points))
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def centroid(points: Column) -> Column:
    """Area centroid; the mean of the corners where the area is 0."""
    p, cross, a = corners(points), crosses(points), signed_area(points)

    def along(axis: int) -> Column:
        moments = [(p[k][axis] + p[(k + 1) % 4][axis]) * cross[k] for k in range(4)]
        mean = (p[0][axis] + p[1][axis] + p[2][axis] + p[3][axis]) / 4
        return F.when(a == 0, mean).otherwise((moments[0] + moments[1] + moments[2] + moments[3]) / F.when(a != 0, a * 6))

    return F.struct(along(0).alias("x"), along(1).alias("y"))
