"""Geometry as Column expressions: points are struct<x,y>, polygons are arrays of points without a closing point."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once: keeps nested expressions from growing with every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(function):
    """Decorator: the first argument is worked out once, however often the function names it."""

    @wraps(function)
    def call(points: Column, *rest, **named) -> Column:
        return let(points, lambda p: function(p, *rest, **named))

    return call


def at(points: Column, i: Column) -> Column:
    """Point i (0-based)."""
    return F.element_at(points, i + 1)


def indexes(points: Column) -> Column:
    return F.sequence(F.lit(0), F.size(points) - 1)


def following(points: Column, i: Column) -> Column:
    return at(points, F.pmod(i + 1, F.size(points)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@bound
def signed_area(points: Column) -> Column:
    """Shoelace sum over two; counter-clockwise is positive where y points up. Fewer than 3 points: 0."""
    terms = F.transform(indexes(points), lambda i: at(points, i)["x"] * following(points, i)["y"] - following(points, i)["x"] * at(points, i)["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(total(terms) / 2)


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


@bound
def side_lengths(points: Column) -> Column:
    return F.transform(indexes(points), lambda i: F.sqrt(_square(following(points, i)["x"] - at(points, i)["x"]) + _square(following(points, i)["y"] - at(points, i)["y"])))


def _square(c: Column) -> Column:
    return c * c


def long_side(points: Column) -> Column:
    return F.array_max(side_lengths(points))


def short_side(points: Column) -> Column:
    return F.array_min(side_lengths(points))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


@bound
def bounds(points: Column) -> Column:
    """struct<x0,y0,x1,y1>."""
    return F.struct(F.array_min(xs(points)).alias("x0"), F.array_min(ys(points)).alias("y0"), F.array_max(xs(points)).alias("x1"), F.array_max(ys(points)).alias("y1"))


@bound
def centroid(points: Column) -> Column:
    """Area centroid; the mean of the points where the area is 0."""
    cross = lambda i: at(points, i)["x"] * following(points, i)["y"] - following(points, i)["x"] * at(points, i)["y"]
    a = signed_area(points)
    cx = total(F.transform(indexes(points), lambda i: (at(points, i)["x"] + following(points, i)["x"]) * cross(i)))
    cy = total(F.transform(indexes(points), lambda i: (at(points, i)["y"] + following(points, i)["y"]) * cross(i)))
    n = F.size(points)
    return F.when(a == 0, point(total(xs(points)) / n, total(ys(points)) / n)).otherwise(point(cx / (a * 6), cy / (a * 6)))


@bound
def closed(ring: Column) -> Column:
    """The ring with its first point added at its end unless it is there."""
    return F.when(F.size(ring) == 0, ring).when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


@bound
def opened(ring: Column) -> Column:
    """The ring without a closing point."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def _clip(points: Column, value, bound: Column, keep_less: bool, axis: str | None = None) -> Column:
    """One side of a box cut off: points whose `value` lies beyond `bound` go, crossings come in; with `axis` they lie on the bound to the last bit."""

    def inside(p: Column) -> Column:
        return value(p) <= bound if keep_less else value(p) >= bound

    def crossing(p: Column, q: Column) -> Column:
        t = (bound - value(p)) / (value(q) - value(p))
        return point(*[bound if f == axis else p[f] + (q[f] - p[f]) * t for f in "xy"])

    def step(pp: Column) -> Column:
        def edge(i: Column) -> Column:
            p, q = at(pp, i), following(pp, i)
            a, b = inside(p), inside(q)
            return F.when(a & b, F.array(q)).when(a, F.array(crossing(p, q))).when(b, F.array(crossing(p, q), q)).otherwise(F.slice(pp, 1, 0))

        return F.when(F.size(pp) == 0, pp).otherwise(F.flatten(F.transform(indexes(pp), edge)))

    return let(points, step)


def clip_to_box(points: Column, x0: Column, y0: Column, x1: Column, y1: Column, around: Column | None = None, exact: bool = False) -> Column:
    """The polygon cut to an upright box; right in area for any simple polygon. With `exact`, cuts lie on the box to the last bit.

    With `around`, the polygon's bounds, sides of the box that they do not cross are not cut at: a cut that cuts nothing
    makes the second corner the first, and no more.
    """
    x, y = (lambda p: p["x"]), (lambda p: p["y"])
    out = points
    sides = ((x, x0, False, "x0"), (x, x1, True, "x1"), (y, y0, False, "y0"), (y, y1, True, "y1"))
    for value, limit, keep_less, edge in sides:
        axis = edge[0] if exact else None
        if around is None:
            out = _clip(out, value, limit, keep_less, axis)
        else:
            clear = around[edge] <= limit if keep_less else around[edge] >= limit
            out = _cut_unless(clear, out, value, limit, keep_less, axis)
    return out


def _cut_unless(clear: Column, points: Column, value, limit: Column, keep_less: bool, axis: str | None = None) -> Column:
    def step(o: Column) -> Column:
        turned = F.concat(F.slice(o, F.lit(2), F.greatest(F.size(o), F.lit(1))), F.slice(o, 1, 1))
        return F.when(clear, turned).otherwise(_clip(o, value, limit, keep_less, axis))

    return let(points, step)


def clip_to_convex(points: Column, window: Column, corners: int) -> Column:
    """The polygon cut to a convex polygon of `corners` points in either order."""

    def cut(w: Column) -> Column:
        out = points
        for k in range(corners):
            a, b = F.element_at(w["w"], k + 1), F.element_at(w["w"], (k + 1) % corners + 1)
            side = lambda p, a=a, b=b: ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])) * w["turn"]
            out = _clip(out, side, F.lit(0.0), False)
        return out

    turn = F.when(signed_area(window) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return let(F.struct(window.alias("w"), turn.alias("turn")), cut)


def _bounds_overlap(a: Column, b: Column) -> Column:
    return let(F.struct(bounds(a).alias("p"), bounds(b).alias("q")), lambda s: (s["p"]["x0"] <= s["q"]["x1"]) & (s["q"]["x0"] <= s["p"]["x1"]) & (s["p"]["y0"] <= s["q"]["y1"]) & (s["q"]["y0"] <= s["p"]["y1"]))


def convex_iou(a: Column, b: Column, corners: int = 4) -> Column:
    """Intersection over union with a convex b; 0 for apart or empty ones, 1 at most."""
    common = area(clip_to_convex(a, b, corners))
    ratio = let(F.struct(common.alias("i"), (area(a) + area(b)).alias("s")), lambda s: F.when(s["s"] - s["i"] > 0, F.least(F.lit(1.0), s["i"] / (s["s"] - s["i"]))).otherwise(F.lit(0.0)))
    return F.when(_bounds_overlap(a, b), ratio).otherwise(F.lit(0.0))


def polygon_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two simple polygons; 0 if either is not valid or they are apart."""
    return batches.polygon_iou(a, b)


def is_simple(points: Column) -> Column:
    """Whether a ring bounds a valid polygon: three corners and an area, and no two sides that meet but neighbours in their common corner.

    Sides that touch or overlap others make a ring invalid, too, and so does one that goes straight back on itself. Closing
    points and repeated corners are passed over.
    """
    return batches.is_simple(points)


def intersects_box(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.size(clip_to_box(points, x0, y0, x1, y1)) > 0


@bound
def line_meets_box(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an open line enters a box (Liang-Barsky on each piece)."""

    def piece(i: Column) -> Column:
        p, q = at(points, i), at(points, i + 1)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        low = lambda v, d, a, b: F.when(d == 0, F.when((v >= a) & (v <= b), F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least((a - v) / d, (b - v) / d))
        high = lambda v, d, a, b: F.when(d == 0, F.when((v >= a) & (v <= b), F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest((a - v) / d, (b - v) / d))
        return F.greatest(F.lit(0.0), low(p["x"], dx, x0, x1), low(p["y"], dy, y0, y1)) <= F.least(F.lit(1.0), high(p["x"], dx, x0, x1), high(p["y"], dy, y0, y1))

    return F.when(F.size(points) < 2, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), F.size(points) - 2), piece))


def min_rotated_rectangle(points: Column) -> Column:
    """Corners of the smallest rectangle around the points, among the directions of all pairs of points.

    These hold the hull's sides, so the minimum is that over the hull. Ties go to the first pair.
    """
    return batches.min_rotated_rectangle(points)


@bound
def enforce_min_side(corners: Column, least: float) -> Column:
    """A parallelogram about the mean of four corners, along the two sides that meet in the first corner, each `least` long at least."""
    p = [F.element_at(corners, k) for k in (1, 2, 3, 4)]
    cx, cy = (p[0]["x"] + p[1]["x"] + p[2]["x"] + p[3]["x"]) / 4, (p[0]["y"] + p[1]["y"] + p[2]["y"] + p[3]["y"]) / 4

    def axis(a: Column, b: Column, x: float, y: float) -> tuple[Column, Column]:
        """Half of the side from a to b, lengthened where it is short."""
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = F.sqrt(dx * dx + dy * dy)
        half = F.greatest(n, F.lit(float(least))) / 2
        return F.when(n == 0, F.lit(x)).otherwise(dx / n) * half, F.when(n == 0, F.lit(y)).otherwise(dy / n) * half

    ux, uy = axis(p[0], p[1], 1.0, 0.0)
    vx, vy = axis(p[0], p[3], 0.0, 1.0)
    return F.array(point(cx - ux - vx, cy - uy - vy), point(cx + ux - vx, cy + uy - vy), point(cx + ux + vx, cy + uy + vy), point(cx - ux + vx, cy - uy + vy))


# Affine transforms: struct<a,b,c,d,e,f>, x' = a x + b y + c and y' = d x + e y + f.


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f))])


def affine_to_text(t: Column) -> Column:
    return F.concat_ws(",", *[t[n].cast("string") for n in "abcdef"])


def affine_from_text(text: Column) -> Column:
    parts = F.split(text, r"\s*,\s*")
    return F.struct(*[F.element_at(parts, k + 1).cast("double").alias(n) for k, n in enumerate("abcdef")])


def apply_affine(t: Column, points: Column, offset: float = 0.0) -> Column:
    """`offset` 0.5 takes pixel centres instead of corners."""
    return F.transform(points, lambda p: point(t["a"] * (p["x"] + offset) + t["b"] * (p["y"] + offset) + t["c"], t["d"] * (p["x"] + offset) + t["e"] * (p["y"] + offset) + t["f"]))


def invert_affine(t: Column, points: Column) -> Column:
    """Null for a transform without an inverse."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    return F.when(det != 0, F.transform(points, lambda p: point((t["e"] * (p["x"] - t["c"]) - t["b"] * (p["y"] - t["f"])) / det, (t["a"] * (p["y"] - t["f"]) - t["d"] * (p["x"] - t["c"])) / det)))


def window_affine(t: Column, x: Column, y: Column) -> Column:
    return F.struct(t["a"].alias("a"), t["b"].alias("b"), (t["c"] + t["a"] * x + t["b"] * y).alias("c"), t["d"].alias("d"), t["e"].alias("e"), (t["f"] + t["d"] * x + t["e"] * y).alias("f"))


def scaled(points: Column, size) -> Column:
    return F.transform(points, lambda p: point(p["x"] / size, p["y"] / size))
