"""Repair of rings that cross or touch themselves: split at their crossings, faces kept by winding number.

The ring's sides are split wherever they meet. As a ring is connected, so is the plane graph of its pieces, and every bounded
face has one boundary. Going over a piece changes the winding number by how often the ring runs along it, so numbers spread
from the outside (0) without any test of points. Kept faces are joined, and their boundary is traced into simple rings:
counter-clockwise around an area, clockwise around a hole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
#: Coordinates closer than this share of the ring's extent are one place.
SNAP = 1e-9
#: Sides that are held against all others at a time.
SIDES = 512


def _crossings(p: np.ndarray, q: np.ndarray, near: float) -> list[tuple[int, float, float]]:
    """(side, share of its way, place as a complex number) of everywhere that sides p to q meet others."""
    out: list[tuple[int, complex]] = []
    d = q - p
    n = len(p)
    low, high = np.minimum(p.real, q.real) - near, np.maximum(p.real, q.real) + near
    bottom, top = np.minimum(p.imag, q.imag) - near, np.maximum(p.imag, q.imag) + near
    for begin in range(0, n, SIDES):
        i = np.arange(begin, min(begin + SIDES, n))
        meet = (low[i, None] <= high) & (low <= high[i, None]) & (bottom[i, None] <= top) & (bottom <= top[i, None]) & (i[:, None] < np.arange(n))
        a, b = np.nonzero(meet)
        a = i[a]
        cross = d[a].real * d[b].imag - d[a].imag * d[b].real
        away = p[b] - p[a]
        slanted = np.abs(cross) > 1e-14 * np.abs(d[a]) * np.abs(d[b])
        with np.errstate(all="ignore"):
            t = (away.real * d[b].imag - away.imag * d[b].real) / cross
            u = (away.real * d[a].imag - away.imag * d[a].real) / cross
        slack_a, slack_b = near / np.maximum(np.abs(d[a]), near), near / np.maximum(np.abs(d[b]), near)
        hit = slanted & (t >= -slack_a) & (t <= 1 + slack_a) & (u >= -slack_b) & (u <= 1 + slack_b)
        for k in np.flatnonzero(hit):
            place = p[a[k]] + d[a[k]] * min(max(t[k], 0.0), 1.0)
            out += [(a[k], place), (b[k], place)]
        for k in np.flatnonzero(~slanted):  # parallel sides meet in each other's ends
            for one, other in ((a[k], b[k]), (b[k], a[k])):
                for end in (p[other], q[other]):
                    off = (end - p[one]) * d[one].conjugate()
                    if abs(off.imag) <= near * abs(d[one]) and 0 <= off.real <= abs(d[one]) ** 2:
                        out.append((one, end))
    return out


def repaired(ring: list[tuple[float, float]], rule: str = "odd") -> list[list[tuple[float, float]]]:
    """Simple rings around the places whose winding number is odd (`odd`) or not 0 (`nonzero`); none for a ring without area."""
    z = np.array([complex(x, y) for x, y in ring])
    if len(z) and z[0] == z[-1]:
        z = z[:-1]
    if len(z) < 3 or not np.isfinite(z).all():
        return []
    z = z[np.append(True, z[1:] != z[:-1])]
    origin = z.mean()
    z = z - origin
    near = SNAP * max(np.ptp(z.real), np.ptp(z.imag))
    if len(z) < 3 or near == 0:
        return []
    p, q = z, np.roll(z, -1)
    places: dict[tuple[int, int], int] = {}
    nodes: list[complex] = []

    def node(c: complex) -> int:
        x, y = round(c.real / near), round(c.imag / near)
        for k in ((x, y), *((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1))):
            if k in places:
                return places[k]
        places[x, y] = len(nodes)
        nodes.append(c)
        return len(nodes) - 1

    corner = [node(c) for c in p]
    on: list[list[int]] = [[a, b] for a, b in zip(corner, corner[1:] + corner[:1])]
    for side, c in _crossings(p, q, near):
        on[side].append(node(c))
    net: dict[tuple[int, int], int] = {}
    for k, held in enumerate(on):
        d = q[k] - p[k]
        way = sorted(set(held), key=lambda i: ((nodes[i] - p[k]) * d.conjugate()).real)
        if way[0] != on[k][0]:
            way.remove(on[k][0])
            way.insert(0, on[k][0])
        for a, b in zip(way, way[1:]):
            net[a, b] = net.get((a, b), 0) + 1
            net[b, a] = net.get((b, a), 0) - 1
    around: dict[int, list[int]] = {}
    for a, b in net:
        around.setdefault(a, []).append(b)
    for a, others in around.items():
        others.sort(key=lambda b: math.atan2((nodes[b] - nodes[a]).imag, (nodes[b] - nodes[a]).real))
    turn = {(a, b): k for a, others in around.items() for k, b in enumerate(others)}
    after = lambda a, b: (b, around[b][turn[b, a] - 1])  # noqa: E731  clockwise from where it came
    face: dict[tuple[int, int], int] = {}
    areas: list[float] = []
    for start in net:
        if start in face:
            continue
        edge, total = start, 0.0
        while edge not in face:
            face[edge] = len(areas)
            a, b = nodes[edge[0]], nodes[edge[1]]
            total += a.real * b.imag - b.real * a.imag
            edge = after(*edge)
        areas.append(total / 2)
    outside = int(np.argmin(areas))
    winding = {outside: 0}
    across: dict[int, list[tuple[int, int]]] = {}
    for (a, b), f in face.items():
        across.setdefault(f, []).append((face[b, a], -net[a, b]))
    waiting = [outside]
    while waiting:
        f = waiting.pop()
        for g, change in across[f]:
            if g not in winding:
                winding[g] = winding[f] + change
                waiting.append(g)
    kept = {f for f, w in winding.items() if f != outside and (w % 2 if rule == "odd" else w)}
    edges = {e for e, f in face.items() if f in kept and face[e[1], e[0]] not in kept}
    rings = []
    while edges:
        first = min(edges)
        edge, path, seen = first, [], {}
        while edge in edges:
            edges.remove(edge)
            a, b = edge
            seen[a] = len(path)
            path.append(a)
            if b in seen:  # a loop is closed: it is a ring of its own
                loop, path = path[seen[b] :], path[: seen[b]]
                for x in loop:
                    seen.pop(x, None)
                rings.append(loop)
            k = turn[b, a]
            edge = next(((b, around[b][k - s]) for s in range(1, len(around[b]) + 1) if (b, around[b][k - s]) in edges), (-1, -1))
    out = []
    for loop in rings:
        points = [nodes[i] + origin for i in loop]
        if len(points) >= 3:
            out.append([(c.real, c.imag) for c in points])
    return out


def repair(points: Column, rule: str = "odd") -> Column:
    """array of rings that bound what a ring encloses; valid rings come back as one. Null and rings without area give none."""
    if rule not in ("odd", "nonzero"):
        raise ValueError("rule must be odd or nonzero")

    @F.pandas_udf(RINGS)
    def work(rings: pd.Series) -> pd.Series:
        told = lambda r: [[{"x": x, "y": y} for x, y in ring] for ring in repaired([(p["x"], p["y"]) for p in r] if r is not None else [], rule)]
        return pd.Series([told(r) for r in rings])

    return work(points)
