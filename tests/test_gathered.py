"""Matching with all of a source in one task: the matches of `greedy_match`, each row shuffled once and no pair written."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from skymosaic.functions import pairing
from skymosaic.operators import evaluate, gathered, inference, quadtree, spatial
from skymosaic.plans import catalogue
from skymosaic.sources import geojson

SF = "/root/testdata/sf0.001"
RING = "array<struct<x:double,y:double>>"
TRUTH, PREDS = f"s int, truth_id string, points {RING}", f"s int, label string, pred_id string, conf double, points {RING}"


def ring(rng, crossed=False):
    """A turned rectangle, a triangle, a pentagon that is not convex, or corners written crosswise."""
    x, y, a, b, turn = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 9), rng.uniform(2, 9), rng.uniform(0, 3)
    kind = rng.random()
    at = [(-a, -b), (a, -b), (a, b), (-a, b)] if kind < 0.6 else [(-a, -b), (a, -b), (0, b)] if kind < 0.75 else [(-a, -b), (a, -b), (a, b), (0, 0), (-a, b)]
    if crossed and kind < 0.4:
        at = [at[k] for k in (0, 2, 1, 3)]
    if kind > 0.97:
        at = at[:2]
    return [(x + p * math.cos(turn) - q * math.sin(turn), y + p * math.sin(turn) + q * math.cos(turn)) for p, q in at]


def sides(spark, seed, sources=(1, 2, 3, 4), crossed=False):
    rng = random.Random(seed)
    truth = [(s, f"t{k}", ring(rng, crossed)) for s in sources for k in range(10 * s)]
    near = [(s, rng.choice("abc"), f"p{k}", rng.random(), [(x + rng.uniform(-1, 1), y) for x, y in r] if rng.random() < 0.8 else ring(rng)) for k, (s, _, r) in enumerate(truth * 2)]
    truth += [(None, "t0", truth[0][2]), (1, None, truth[1][2]), (1, "null", None), (2, "gap", [(0.0, 0.0), None, (1.0, 1.0)]), (3, "flat", [(1.0, 1.0)] * 4), (4, "none", [])]
    near += [(None, "a", "p0", 0.5, near[0][4]), (1, "a", None, 0.5, near[1][4]), (1, None, "q", 0.5, near[2][4]), (9, "c", "alone", None, near[3][4]), (2, "a", "null", 0.1, None)]
    rng.shuffle(truth)
    rng.shuffle(near)
    return spark.createDataFrame(truth, TRUTH).repartition(3), spark.createDataFrame(near, PREDS).repartition(3)


def by_pairs(truth, preds, label, threshold, rule):
    t, p = truth.withColumnRenamed("points", "truth_points"), preds.withColumnRenamed("points", "pred_points")
    pairs = spatial.repaired_pairs(t, p, "s", rule=rule) if rule else spatial.polygon_pairs(t, p, "s")
    found = evaluate.greedy_match(pairs, ["s", *([label] if label else [])], threshold)
    return {(r.s, r[label] if label else None, r.truth_id, r.pred_id): round(r.iou, 9) for r in found.collect() if not label or r[label] is not None}


@pytest.mark.parametrize("label, rule, most", [("label", None, 1_000), (None, None, 1_000), (None, "odd", 1_000), ("label", None, 60), (None, "odd", 60)])
def test_matches_are_those_of_pairs(spark, label, rule, most):
    truth, preds = sides(spark, 7, crossed=bool(rule))
    found = gathered.match_by_source(truth, preds, "s", label, 0.3, rule, carried=["conf"] if label else ["conf", "label"], points=True, most=most).collect()
    wanted = by_pairs(truth, preds, label, 0.3, rule)
    assert len(wanted) > 40
    made = [r for r in found if not r.is_truth]
    assert {(r.s, r[label] if label else None, r.truth_id, r.pred_id): round(r.iou, 9) for r in made if r.iou is not None} == wanted
    assert all(r.truth_id is None for r in made if r.iou is None)
    hits = {(r.s, h.label if label else None, r.truth_id, h.pred_id) for r in found if r.is_truth for h in r.hits}
    assert hits == set(wanted)
    rows = lambda rs: sorted(rs, key=repr)  # noqa: E731  every row is there, with what it carries
    plain = lambda ps: None if ps is None else [None if p is None or p.x is None else (p.x, p.y) for p in ps]
    assert rows((r.s, r.truth_id, plain(r.points)) for r in found if r.is_truth) == rows((r.s, r.truth_id, plain(r.points)) for r in truth.collect())
    assert rows((r.s, r.label, r.pred_id, r.conf, plain(r.points)) for r in made) == rows((r.s, r.label, r.pred_id, r.conf, plain(r.points)) for r in preds.collect())


def test_slices_change_nothing(spark, monkeypatch):
    """Candidates are worked a few at a time, and chunks hold a few rows: the same matches."""
    truth, preds = sides(spark, 3)
    wanted = by_pairs(truth, preds, "label", 0.3, None)
    monkeypatch.setattr(pairing.meeting, "__defaults__", (5,))
    monkeypatch.setattr(pairing.whole_sources, "__defaults__", (30,))
    rows = [r for part in (truth, preds) for r in part.filter("s = 4").collect()]
    name = lambda r: r.truth_id if "truth_id" in r else r.pred_id
    import numpy as np
    import pyarrow as pa

    is_truth = np.array(["truth_id" in r for r in rows])
    ids = pairing.ranks(pa.array([name(r) or "" for r in rows]))
    label = np.array([-1 if "truth_id" in r or r.label is None else "abc".index(r.label) for r in rows])
    xy = pa.array([None if r.points is None else [v for p in r.points for v in ((p.x, p.y) if p else (None, None))] for r in rows], pa.list_(pa.float64()))
    t, p, _ = pairing.matches(np.zeros(len(rows), int), is_truth, ids, label, xy, 0.3, None)
    assert {(4, rows[b].label, rows[a].truth_id, rows[b].pred_id) for a, b in zip(t, p)} == {k for k in wanted if k[0] == 4}
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(part, pa.int64())}) for part in ([None, None, 1], [1, 1], [1] * 40, [2] * 20 + [3] * 30, [3, 4])]
    told = [b.column(0).to_pylist() for b in pairing.whole_sources(iter(batches))]
    assert sum(told, []) == [None, None] + [1] * 43 + [2] * 20 + [3] * 31 + [4]
    assert all(not set(a) & set(b) for k, a in enumerate(told) for b in told[k + 1 :])


@pytest.mark.parametrize("most", [1_000, 30])
def test_merged_as_in_turn(spark, most):
    rng = random.Random(5)
    rows = [(s, f"d{k}", rng.choice("ab"), rng.choice([0.2, 0.5, 0.9, math.nan]), [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
            for s in (1, 2, 3) for k in range(15 * s) for x, y, w, h in [[rng.uniform(a, 12) for a in (0, 0, 4, 4)]]]
    found = gathered.uncovered_by_source(spark.createDataFrame(rows, f"s int, det_id string, label string, conf double, points {RING}").repartition(3), "s", "label", 0.5, most)
    got = {(r.s, r.det_id) for r in found[0].collect()}
    larger = found[1] and inference._merge_large(found[1], "s", "label", 0.5, 384.0)
    got |= {(r.s, r.det_id) for r in larger.collect()} if larger is not None else set()
    assert (larger is None) == (most == 1_000)
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], not math.isnan(r[3]), -r[3] if r[3] == r[3] else 0, r[1])):
        size = lambda q: (q[1][0] - q[0][0]) * (q[2][1] - q[1][1])
        common = lambda a, b: max(0, min(a[2][0], b[2][0]) - max(a[0][0], b[0][0])) * max(0, min(a[2][1], b[2][1]) - max(a[0][1], b[0][1]))
        if not any(k[0] == r[0] and k[2] == r[2] and common(k[4], r[4]) >= 0.5 * min(size(k[4]), size(r[4])) for k in kept):
            kept.append(r)
    assert got == {(r[0], r[1]) for r in kept} and len(got) < len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["outcome_features", "match_repaired_truth", "best_threshold_per_label", "threshold_sweep_f1", "match_outcomes", "merge_sliced_detections"])
def test_rows_are_shuffled_once(spark, monkeypatch, name):
    """No pairs are written, and polygons are shuffled by their source only."""

    def never(_):
        raise AssertionError("written")

    for module in (evaluate, quadtree, gathered):
        monkeypatch.setattr(module, "checkpointed", never)
    monkeypatch.setattr("skymosaic.session.checkpointed", never)
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [source_id") == 1
    ids = [line for line in plan.splitlines() if "Join " in line and ("pred_id" in line or "truth_id" in line or "det_id" in line)]
    assert not ids


def test_far_coordinates(spark):
    """Metres of a map, millions from the origin: what boxes share is no ground to leave out a pair that reaches the threshold."""
    rng = random.Random(1)
    truth = [(1, f"t{k}", [(7e6 + x, 8e6 + y) for x, y in ring(rng)]) for k in range(60)]
    preds = [(1, "a", f"p{k}", 0.5, [(x + rng.uniform(-2, 2), y) for x, y in r]) for k, (_, _, r) in enumerate(truth)]
    truth, preds = spark.createDataFrame(truth, TRUTH), spark.createDataFrame(preds, PREDS)
    found = gathered.match_by_source(truth, preds, "s", "label", 0.5).filter("iou is not null").select("truth_id", "pred_id", F.round("iou", 6))
    wanted = by_pairs(truth, preds, "label", 0.5, None)
    assert {(r[0], r[1]) for r in found.collect()} == {k[2:] for k in wanted} and len(wanted) > 20


def test_outcomes_are_those_of_joins(spark):
    """Features of every label and outcome, each text made once and packed into each of its collections."""
    truth, preds = sides(spark, 11)
    t, p = truth.filter("truth_id is not null and s is not null"), preds.filter("pred_id is not null and s is not null")
    found = gathered.match_by_source(t, p, "s", "label", 0.3, points=True)
    texts = geojson.packed_collections(evaluate.outcomes_by_source(found, p.select("label"), "s", "label"), ["label", "outcome"], of="collections")
    pairs = spatial.polygon_pairs(t.withColumnRenamed("points", "truth_points"), p.withColumnRenamed("points", "pred_points"), "s")
    matches = evaluate.greedy_match(pairs, ["s", "label"], 0.3).filter("label is not null")
    wanted = evaluate.outcomes(t, p, matches, ["s"], "label").select("label", "outcome", "properties.*").collect()
    told = evaluate.outcomes_by_source(found, p.select("label"), "s", "label").select(F.explode("collections").alias("c"), "properties").select("c.*", "properties.*").collect()
    assert sorted(map(tuple, told), key=repr) == sorted(map(tuple, wanted), key=repr) and len(told) > 400
    sound = F.expr("size(points) > 0 and forall(points, p -> p is not null)")
    back = geojson.parse_collections(texts, "content", "s int, truth_id string, pred_id string").select("label", "outcome", "properties.*", F.size("points").alias("n"))
    ids = {(r.s, r.truth_id) for r in t.filter(sound).collect()} | {(r.s, r.pred_id) for r in p.filter(sound).collect()}
    keep = lambda rs: sorted((tuple(r[:5]) for r in rs if (r.s, r.truth_id or r.pred_id) in ids), key=repr)
    assert keep(back.filter("n > 0").collect()) == keep(wanted)


def test_collections_with_odd_features_are_read_as_before(spark):
    """One go for sound polygons, texts for what else there is: the same rings."""
    shapes = ['{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,2.5],[0,0]],[[0.1,0.1],[0.2,0.1],[0.2,0.2]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}',
              '{"type":"Polygon","coordinates":[[[0,0],[1,null],[1,1],[2,2,7]]]}', '{"type":"Polygon","coordinates":[[[0,0],["x",1],[1,1]]]}', '{"type":"Polygon","coordinates":[]}', '{"type":"Point","coordinates":[1,2]}', "null"]
    one = lambda *s: '{"type":"FeatureCollection","features":[' + ",".join(f'{{"type":"Feature","properties":{{"class_id":{k}}},"geometry":{g}}}' for k, g in enumerate(s)) + "]}"
    texts = spark.createDataFrame([("plain", one(shapes[0], shapes[0])), ("odd", one(*shapes)), ("bad", "no json"), ("other", '{"type":"Feature"}')], "name string, content string")
    rows = geojson.parse_collections(texts, "content").orderBy("name", "properties.class_id").collect()
    got = [(r.name, r.properties.class_id, r.points and [(p.x, p.y) for p in r.points]) for r in rows]
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 2.5)]
    assert got[-2:] == [("plain", 0, ring), ("plain", 1, ring)] and {n for n, *_ in got} == {"odd", "plain"}
    odd = [(k, p) for n, k, p in got if n == "odd"]
    assert odd[0] == (0, ring) and [p for k, p in odd if k == 1] == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]]
    assert [p for k, p in odd if k == 2] == [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]] and all(not p for k, p in odd if k > 3)
