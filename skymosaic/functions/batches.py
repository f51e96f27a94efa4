"""Measures of many polygons at a time: Arrow batches as rows of coordinates, where lambdas would go corner by corner.

Functions of x and y (rows x corners) work on polygons of one number of corners; `by_size` deals a batch to them. The order of
arithmetic is that of `geometry`. Rows with a null ring or a null in a ring give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = tuple[np.ndarray, np.ndarray]


def by_size(*rings: pa.Array) -> Iterator[tuple[np.ndarray, list[Ring]]]:
    """(places of rows, x and y of each argument) for each combination of numbers of corners."""
    ok = np.ones(len(rings[0]), bool)
    held = []
    for r in rings:
        offsets = r.offsets.to_numpy()
        flat = r.values.flatten()
        x, y = (flat[r.type.value_type.get_field_index(f)] for f in "xy")
        ok &= r.is_valid().to_numpy(zero_copy_only=False)
        missing = np.concatenate([[0], np.cumsum(x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False))])
        ok &= missing[offsets[1:]] == missing[offsets[:-1]]
        held.append((offsets[:-1], np.diff(offsets), x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)))
    rows = np.flatnonzero(ok)
    sizes, group = np.unique(np.stack([n[rows] for _, n, _, _ in held], 1), axis=0, return_inverse=True)
    for k, size in enumerate(sizes):
        at = rows[group.ravel() == k]
        places = [first[at][:, None] + np.arange(n) for (first, _, _, _), n in zip(held, size)]
        yield at, [(x[p], y[p]) for (_, _, x, y), p in zip(held, places)]


def measured(rings: tuple[pa.Array, ...], measure: Callable[..., np.ndarray], kind: pa.DataType) -> pa.Array:
    """`measure` of every row."""
    out, known = np.zeros(len(rings[0]), kind.to_pandas_dtype()), np.zeros(len(rings[0]), bool)
    for at, found in by_size(*rings):
        out[at], known[at] = measure(at, *found), True
    return pa.array(out, kind, mask=~known)


def shoelace(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed areas of rings that lie in their rows' first `n` columns."""
    out = np.zeros(len(x))
    at = np.arange(len(x))
    for i in range(x.shape[1]):
        j = np.where(i + 1 < n, i + 1, 0) if i + 1 < x.shape[1] else np.zeros(len(x), int)
        out = np.where(i < n, out + (x[:, i] * y[at, j] - x[at, j] * y[:, i]), out)
    return np.where(n < 3, 0.0, out / 2)


def areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(shoelace(x, y, np.full(len(x), x.shape[1])))


def cut(x: np.ndarray, y: np.ndarray, n: np.ndarray, keep: np.ndarray, share) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polygons without the points that are not kept, crossings added at `share` of the way; a row's points lie in its first `n` columns."""
    rows = np.arange(len(x))[:, None]
    after = (np.arange(x.shape[1])[None, :] + 1) % np.maximum(n, 1)[:, None]
    qx, qy, q_in = x[rows, after], y[rows, after], keep[rows, after]
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    with np.errstate(all="ignore"):
        t = share((x, y), (qx, qy))
        cx, cy = x + (qx - x) * t, y + (qy - y) * t
    # at each point: the crossing, then the next point
    made = np.stack([live & (keep != q_in), live & q_in], 2).reshape(len(x), -1)
    n = made.sum(1)
    order = np.argsort(~made, axis=1, kind="stable")[:, : max(1, n.max(initial=0))]
    used = np.arange(order.shape[1])[None, :] < n[:, None]
    x, y = (np.where(used, np.stack([c, q], 2).reshape(len(x), -1)[rows, order], 0.0) for c, q in ((cx, qx), (cy, qy)))
    return x, y, n


def common_with_convex(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Area that polygons (rows of x, y) share with convex ones (rows of u, v), in the arithmetic of `clip_to_convex`."""
    rows = np.arange(len(x))[:, None]
    corners = u.shape[1]
    n = np.full(len(x), x.shape[1])
    turn = np.where(shoelace(u, v, np.full(len(x), corners)) < 0, -1.0, 1.0)[:, None]
    for k in range(corners):
        ax, ay, bx, by = (c[:, None] for c in (u[:, k], v[:, k], u[:, (k + 1) % corners], v[:, (k + 1) % corners]))
        side = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * turn
        after = (np.arange(x.shape[1])[None, :] + 1) % np.maximum(n, 1)[:, None]
        x, y, n = cut(x, y, n, side >= 0, lambda p, q, s=side, a=after: (0.0 - s) / (s[rows, a] - s))
    return np.abs(shoelace(x, y, n))


def common_with_box(x: np.ndarray, y: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
    """Area of polygons in upright boxes (x0, y0, x1, y1), in the arithmetic of `clip_to_box`."""
    n = np.full(len(x), x.shape[1])
    for axis, limit, keep_less in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        bound = limit[:, None]
        value = (x, y)[axis]
        x, y, n = cut(x, y, n, value <= bound if keep_less else value >= bound, lambda p, q, a=axis, b=bound: (b - p[a]) / (q[a] - p[a]))
    return np.abs(shoelace(x, y, n))


def common(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Area that simple polygons share: signed sum over both fans of triangles."""
    out = np.zeros(len(x))
    three = np.full(len(x), 3)
    for i in range(1, x.shape[1] - 1):
        a, b = x[:, [0, i, i + 1]], y[:, [0, i, i + 1]]
        turn, inner = np.sign(shoelace(a, b, three)), np.zeros(len(x))
        for j in range(1, u.shape[1] - 1):
            c, d = u[:, [0, j, j + 1]], v[:, [0, j, j + 1]]
            sign = turn * np.sign(shoelace(c, d, three))
            inner = inner + np.where(sign == 0, 0.0, sign * common_with_convex(a, b, c, d))
        out = out + inner
    return np.abs(out)


def convex_quads(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[1] != 4:
        return np.zeros(len(x), bool)
    turns = [(x[:, (k + 1) % 4] - x[:, k]) * (y[:, (k + 2) % 4] - y[:, (k + 1) % 4]) - (y[:, (k + 1) % 4] - y[:, k]) * (x[:, (k + 2) % 4] - x[:, (k + 1) % 4]) for k in range(4)]
    return np.logical_and.reduce([t > 0 for t in turns]) | np.logical_and.reduce([t < 0 for t in turns])


def simple(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rings bound valid polygons; see `geometry.is_simple`."""
    out = convex_quads(x, y)
    rest = np.flatnonzero(~out)
    if not len(rest) or x.shape[1] == 0:
        return out
    x, y = x[rest], y[rest]
    kept = np.ones(x.shape, bool)
    kept[:, 1:] = (x[:, 1:] != x[:, :-1]) | (y[:, 1:] != y[:, :-1])
    if x.shape[1] > 1:  # a closing point
        kept[:, -1] &= (x[:, 0] != x[:, -1]) | (y[:, 0] != y[:, -1])
    size = kept.sum(1)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n >= 3:
            out[rest[at]] = _plain(x[at][kept[at]].reshape(-1, n), y[at][kept[at]].reshape(-1, n))
    return out


def _plain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = x.shape[1]

    def turn(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def over(a, b, c, d):
        return (np.minimum(a, b) <= np.maximum(c, d)) & (np.minimum(c, d) <= np.maximum(a, b))

    qx, qy, rx, ry = np.roll(x, -1, 1), np.roll(y, -1, 1), np.roll(x, -2, 1), np.roll(y, -2, 1)
    bad = areas(x, y) == 0
    bad |= ((turn(x, y, qx, qy, rx, ry) == 0) & ((qx - x) * (rx - qx) + (qy - y) * (ry - qy) < 0)).any(1)
    for i in range(n - 2):  # against the sides that are no neighbours of side i
        j = slice(i + 2, n if i else n - 1)
        p, q, r, s = (x[:, i, None], y[:, i, None]), (qx[:, i, None], qy[:, i, None]), (x[:, j], y[:, j]), (qx[:, j], qy[:, j])
        near = over(p[0], q[0], r[0], s[0]) & over(p[1], q[1], r[1], s[1])
        bad |= (near & (turn(*p, *q, *r) * turn(*p, *q, *s) <= 0) & (turn(*r, *s, *p) * turn(*r, *s, *q) <= 0)).any(1)
    return ~bad


def shared(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Area that polygons share; rings that bound no valid polygon share nothing. Convex quadrilaterals, the usual case, are cut as they are."""
    out = np.zeros(len(x))
    plain = convex_quads(x, y) & convex_quads(u, v)
    if plain.any():
        out[plain] = common_with_convex(x[plain], y[plain], u[plain], v[plain])
    rest = np.flatnonzero(~plain)
    rest = rest[simple(x[rest], y[rest]) & simple(u[rest], v[rest])] if len(rest) else rest
    if len(rest):
        out[rest] = common(x[rest], y[rest], u[rest], v[rest])
    return out


def iou(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if not x.shape[1] or not u.shape[1]:
        return np.zeros(len(x))
    meet = (x.min(1) <= u.max(1)) & (u.min(1) <= x.max(1)) & (y.min(1) <= v.max(1)) & (v.min(1) <= y.max(1)) & simple(x, y) & simple(u, v)
    out = np.zeros(len(x))
    x, y, u, v = (c[meet] for c in (x, y, u, v))
    i = common(x, y, u, v)
    union = areas(x, y) + areas(u, v) - i
    with np.errstate(all="ignore"):
        out[meet] = np.where(union > 0, np.minimum(1.0, i / union), 0.0)
    return out


def rectangles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the smallest rectangles around points; see `geometry.min_rotated_rectangle`."""
    m, n = x.shape
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    best, frame = np.zeros(m), np.zeros((6, m))
    for i in range(n):
        for j in range(i + bool(i), n):  # a point with itself stands for the axes, once
            dx, dy = x[j] - x[i], y[j] - y[i]
            d = np.sqrt(dx * dx + dy * dy)
            with np.errstate(all="ignore"):
                c, s = np.where(d == 0, 1.0, dx / d), np.where(d == 0, 0.0, dy / d)
            us, vs = x * c + y * s, y * c - x * s
            told = (us.min(0), us.max(0), vs.min(0), vs.max(0), c, s)
            area = (told[1] - told[0]) * (told[3] - told[2])
            better = np.ones(m, bool) if i == j else area < best - 1e-12
            best = np.where(better, area, best)
            frame = np.where(better, told, frame)
    u0, u1, v0, v1, c, s = frame
    corners = [(u * c - v * s, u * s + v * c) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))]
    return np.stack([p for p, _ in corners], 1), np.stack([q for _, q in corners], 1)


# Columns. Functions that other operators filter by are told to Spark as not deterministic, so that no filter repeats them.


def is_simple(points: Column) -> Column:
    return F.arrow_udf(lambda r: measured((r,), lambda _, p: simple(*p), pa.bool_()), "boolean")(points)


def polygon_iou(a: Column, b: Column) -> Column:
    return F.arrow_udf(lambda r, s: measured((r, s), lambda _, p, q: iou(*p, *q), pa.float64()), "double")(a, b)


def shared_area(a: Column, b: Column) -> Column:
    return F.arrow_udf(lambda r, s: measured((r, s), lambda _, p, q: shared(*p, *q), pa.float64()), "double").asNondeterministic()(a, b)


def area_in_box(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    def work(r: pa.Array, *box: pa.Array) -> pa.Array:
        edges = [b.to_numpy(zero_copy_only=False) for b in box]
        return measured((r,), lambda at, p: common_with_box(*p, [e[at] for e in edges]), pa.float64())

    return F.arrow_udf(work, "double").asNondeterministic()(points, x0, y0, x1, y1)


def min_rotated_rectangle(points: Column) -> Column:
    def work(r: pa.Array) -> pa.Array:
        x, y, known = np.zeros((len(r), 4)), np.zeros((len(r), 4)), np.zeros(len(r), bool)
        for at, (p,) in by_size(r):
            if p[0].shape[1]:
                (x[at], y[at]), known[at] = rectangles(*p), True
        corners = pa.StructArray.from_arrays([pa.array(x.ravel()), pa.array(y.ravel())], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * 4, pa.int32()), corners, mask=pa.array(~known))

    return F.arrow_udf(work, "array<struct<x:double,y:double>>")(points)
