"""Adaptive cells, pairs of polygons of any shape, matching in turn and mean average precision, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymosaic.functions import geometry as G
from skymosaic.operators import evaluate, quadtree, spatial

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
RING = "array<struct<x:double,y:double>>"


def meeting(a, b):
    return sorted((i, j) for k, i, p in a for l, j, q in b if k == l and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])


@pytest.mark.parametrize("most", [None, 5, 20, 10_000])
def test_box_join_is_that_of_all_pairs(spark, most):
    rng = random.Random(2)
    box = lambda size: (lambda x, y: (x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)))(rng.uniform(-500, 1500), rng.uniform(-500, 1500))
    a = [(i % 2, i, box(600)) for i in range(60)] + [(1, 100 + i, (300.0, 300.0, 301.0, 301.0)) for i in range(30)]
    b = [(i % 2, i, box(40)) for i in range(90)] + [(1, 100 + i, (300.5, 300.5, 302.0, 302.0)) for i in range(30)] + [(1, 200, (384.0, 384.0, 384.0, 384.0)), (1, 201, (-384.0, -768.0, 0.0, 0.0))]
    left, right = spark.createDataFrame(a, f"k int, i int, lbox {BOX}"), spark.createDataFrame(b, f"k int, j int, rbox {BOX}")
    assert sorted((r.i, r.j) for r in spatial.box_join(left, right, "k", most=most).collect()) == meeting(a, b)


def test_a_crowded_cell_is_split(spark):
    """One source with one crowded cell: no cell of the plan holds more than 3 times the median of the full ones."""
    rng = np.random.default_rng(7)
    n, most = 40_000, 1_500
    x, y = rng.uniform(0, 380, n), rng.uniform(0, 380, n)
    crowd = [(1, (float(u), float(v), float(u) + 2, float(v) + 2)) for u, v in zip(x, y)]
    calm = [(s, (float(u), float(v), float(u) + 2, float(v) + 2)) for s in range(2, 12) for u, v in rng.uniform(0, 1500, (200, 2))]
    right = spark.createDataFrame(crowd + calm, f"key int, box {BOX}")
    left = spark.createDataFrame([(s, (384.0 * i, 384.0 * j, 384.0 * i + 768, 384.0 * j + 768)) for s in range(1, 12) for i in range(4) for j in range(4)], f"key int, box {BOX}")
    plan = quadtree.crowded(left, right, 384.0, most)
    assert plan
    sizes = [r["count"] for r in quadtree.loads(right, "key", "box", 384.0, plan, "right").filter("key = 1").collect()]
    assert max(sizes) <= most and max(sizes) <= 3 * np.median(sizes)
    whole = [r["count"] for r in quadtree.loads(right, "key", "box", 384.0, [], "right").filter("key = 1").collect()]
    assert max(whole) > 20 * most
    assert not quadtree.crowded(left, right.filter("key > 1"), 384.0, most)


def test_boxes_in_one_place_are_salted(spark):
    right = spark.createDataFrame([(1, i, (10.0, 10.0, 12.0, 12.0)) for i in range(4_000)], f"key int, j int, rbox {BOX}")
    left = spark.createDataFrame([(1, i, (0.0, 0.0, 768.0, 768.0)) for i in range(3)], f"key int, i int, lbox {BOX}")
    assert spatial.box_join(left, right, "key", most=500).select("i", "j").distinct().count() == 12_000
    assert spatial.box_join(left, right, "key", most=500).count() == 12_000
    plan = quadtree.crowded(left.withColumnRenamed("lbox", "box"), right.withColumnRenamed("rbox", "box"), 384.0, 500)
    sizes = [r["count"] for r in quadtree.loads(right, "key", "rbox", 384.0, plan, "right").collect()]
    assert max(sizes) < 1_500


def star(rng, corners, cx, cy):
    """A simple ring around a place, convex or not."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in angles for r in [rng.uniform(3, 10)]]


def raster(ring, x, y):
    hit = np.zeros(x.shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        hit ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0 + 1e-300) + x0)
    return hit


def test_pairs_of_rings_of_3_to_12_corners(spark):
    rng = random.Random(5)
    truth = [(1, f"t{i:02}", star(rng, rng.randint(3, 12), rng.uniform(0, 30), rng.uniform(0, 30))) for i in range(25)]
    preds = [(1, f"p{i:02}", [(x + rng.uniform(-1, 1), y) for x, y in truth[i % 25][2]]) for i in range(20)] + [(1, f"p{i:02}", star(rng, rng.randint(3, 12), rng.uniform(0, 30), rng.uniform(0, 30))) for i in range(20, 30)]
    dart = [(0.0, 0.0), (10.0, 0.0), (2.0, 2.0), (0.0, 10.0)]
    truth += [(2, "square", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (2, "empty", [])]
    preds += [(2, "dart", dart), (2, "crossed", [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]), (2, "nothing", [])]
    df = spatial.polygon_pairs(spark.createDataFrame(truth, f"s int, truth_id string, truth_points {RING}"), spark.createDataFrame(preds, f"s int, pred_id string, pred_points {RING}"), "s")
    got = {(r.truth_id, r.pred_id): r.iou for r in df.collect()}
    valid = dict(spark.createDataFrame([(i, r) for _, i, r in truth + preds if r], f"i string, r {RING}").select("i", G.is_simple(F.col("r"))).collect())
    x, y = np.meshgrid(np.arange(-12, 42, 0.05) + 0.0251, np.arange(-12, 42, 0.05) + 0.0251)
    flat = {i: raster(r, x, y) for _, i, r in truth + preds if r}
    for s, t, a in truth:
        for u, p, b in preds:
            if s != u or not a or not b:
                continue
            want = (flat[t] & flat[p]).sum() / (flat[t] | flat[p]).sum() if valid[t] and valid[p] else 0.0
            assert abs(got.get((t, p), 0.0) - want) < 0.02, (t, p)
    assert abs(got["square", "dart"] - 0.2) < 1e-9 and got["square", "crossed"] == 0.0 and ("empty", "dart") not in got


@pytest.mark.parametrize(
    ("ring", "valid"),
    [
        ([(0, 0), (4, 0), (4, 4), (0, 4)], True),
        ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], True),  # closed
        ([(0, 0), (4, 0), (4, 0), (4, 4), (0, 4)], True),  # a corner written twice
        ([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], True),  # a corner on a straight side
        ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], False),  # a corner touches a side
        ([(0, 0), (4, 0), (4, 4), (4, 0), (0, 4)], False),  # back on itself
        ([(0, 0), (6, 0), (3, 0), (3, 3)], False),  # a spike
        ([(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)], False),  # touches itself in a corner
        ([(0, 0), (4, 4), (4, 0), (0, 4)], False),
        ([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)], True),
        ([(0, 0), (0, 0), (0, 0)], False),
        ([], False),
    ],
)
def test_valid_rings(spark, ring, valid):
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],)], f"r {RING}")
    assert df.select(G.is_simple(F.col("r"))).first()[0] is valid


def test_min_side_of_an_uneven_quadrilateral(spark):
    """The box stands on the sides from the first corner to the second and to the last."""
    p = [(0.0, 0.0), (4.0, 0.0), (5.0, 3.0), (0.0, 3.0)]
    got = spark.createDataFrame([(p,)], f"r {RING}").select(G.enforce_min_side(F.col("r"), 2.0)).first()[0]
    assert [tuple(c) for c in got] == [(0.25, 0.0), (4.25, 0.0), (4.25, 3.0), (0.25, 3.0)]


def matched(rows, order, other, thresholds):
    out = set()
    for t in thresholds:
        used = set()
        for c in sorted({order(r) for r in rows}):
            free = sorted((-r[4], other(r)) for r in rows if order(r) == c and r[4] >= t and other(r) not in used)
            if free:
                used.add(free[0][1])
                out.add((t, c[-1], free[0][1]))
    return out


@pytest.mark.parametrize("most", [1, 100, 1_000_000])
def test_matching_in_turn_is_that_of_one_loop(spark, most):
    rng = random.Random(most)
    conf = {(s, p): rng.choice([0.1, 0.5, 0.5, 0.9]) for s in range(4) for p in range(30)}
    rows = [(s, f"t{t:02}", f"p{p:02}", conf[s, p], round(rng.uniform(0.4, 1.0), 2)) for s in range(4) for t in range(25) for p in rng.sample(range(30), 1 + 5 * (s > 0))]
    rows += rows[:20] + [(9, None, "p00", 0.5, 0.9), (9, "t00", None, 0.5, 0.9), (None, "t00", "p00", 0.5, 0.9)]
    df = spark.createDataFrame(rows, "s int, truth_id string, pred_id string, conf double, iou double")
    key = lambda k: "none" if k is None else k
    groups = [(s, [r for r in rows if r[0] == s and r[1] and r[2]]) for s in (0, 1, 2, 3, None)]
    got = {(key(r.s), r.truth_id, r.pred_id) for r in evaluate.greedy_match(df, ["s"], 0.5, most).collect()}
    assert got == {(key(s), t, p) for s, mine in groups for _, t, p in matched(mine, lambda r: (r[1],), lambda r: r[2], [0.5])}
    grid = [0.5, 0.75, 0.9]
    got = {(key(r.s), r.threshold, r.pred_id, r.truth_id) for r in evaluate.match_by_confidence(df, ["s"], grid, most).collect()}
    assert got == {(key(s), t, p, x) for s, mine in groups for t, p, x in matched(mine, lambda r: (-r[3], r[2]), lambda r: r[1], grid)}


def test_mean_average_precision(spark):
    rng = random.Random(11)
    truth = [(s, f"t{t}", rng.choice("abc")) for s in range(3) for t in range(30)] + [(0, "lone", "d")]
    preds = [(s, f"p{p}", rng.choice("abx"), round(rng.random(), 1)) for s in range(3) for p in range(40)]
    pairs = [(s, c, t, p, k, round(rng.uniform(0.3, 1), 3)) for s, t, c in truth for u, p, l, k in preds if s == u and c == l and rng.random() < 0.2]
    got = evaluate.mean_average_precision(
        spark.createDataFrame(pairs, "s int, label string, truth_id string, pred_id string, conf double, iou double"),
        spark.createDataFrame(preds, "s int, pred_id string, label string, conf double"), spark.createDataFrame(truth, "s int, truth_id string, label string"), ["s"],
    )
    got = {(r.label, r.threshold): r.ap for r in got.collect()}
    want = {}
    for c in "abcd":
        total = sum(x[2] == c for x in truth)
        for t in evaluate.IOUS:
            hits = {(s, p) for s in range(3) for _, p, _ in matched([(0, x[2], x[3], x[4], x[5]) for x in pairs if x[0] == s and x[1] == c], lambda r: (-r[3], r[2]), lambda r: r[1], [t])}
            mine = [(k, (s, p) in hits) for s, p, l, k in preds if l == c]
            steps = []
            for k in sorted({k for k, _ in mine}, reverse=True):
                upto = [h for x, h in mine if x >= k]
                steps.append((sum(upto) / total, sum(upto) / len(upto)))
            want[c, t] = sum(max((p for r, p in steps if r >= k / 100 - 1e-12), default=0.0) for k in range(101)) / 101
        want[c, None] = sum(want[c, t] for t in evaluate.IOUS) / 10
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got["d", None] == 0.0 and got["a", 0.5] > got["a", 0.95]
