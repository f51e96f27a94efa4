"""Alignment, invalid truths, written outcomes, precision, merged slices and quantiles, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymosaic.config import Config
from skymosaic.functions import geometry as G
from skymosaic.functions import quads as Q
from skymosaic.operators import align, cluster, evaluate, inference, labels, quantiles, report, tiling
from skymosaic.sources import geojson

POINTS = "points array<struct<x:double,y:double>>"


def square(x, y, w=10.0, h=10.0):
    x, y = float(x), float(y)
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_alignment_decides_by_what_is_known(spark):
    degrees = spark.createDataFrame([("a", square(45.0, -20.0, 0.001, 0.001)), ("b", square(500.0, 0.0))], f"ann_id string, {POINTS}")
    metres = spark.createDataFrame([("a", square(500_000.0, 7_000_000.0))], f"ann_id string, {POINTS}")
    first = lambda df: df.orderBy("ann_id").first().points[0]
    # truth without a system whose first polygon has small coordinates is in degrees
    truth, _, crs = align.align_projections(degrees, metres, None, 32738)
    x, y = first(truth)
    assert crs == 32738 and abs(x - 500_000) < 1e-3 and 7_700_000 < y < 7_800_000
    # and in the predictions' system where they are large
    truth, _, crs = align.align_projections(metres, metres, None, 32738)
    assert crs == 32738 and first(truth).x == 500_000.0
    # predictions without a system take the forced one, else the truth's
    assert align.align_projections(degrees, metres, 4326, None, 32738)[2] == 32738
    truth, _, crs = align.align_projections(degrees, metres, 4326, None)
    assert crs == 4326 and first(truth).x == 45.0
    back = align.align_projections(align.align_projections(degrees.limit(1), metres, 4326, 32738)[0], degrees, 32738, 4326)[0]
    assert abs(first(back).x - 45.0) < 1e-9
    with pytest.raises(ValueError, match="EPSG:3857"):
        align.reproject(F.col("points"), 4326, 3857)
    names = spark.createDataFrame([("EPSG:32739",), ("urn:ogc:def:crs:EPSG::4326",), ("urn:ogc:def:crs:OGC:1.3:CRS84",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.select(align.crs_number(F.col("n"))).collect()] == [32739, 4326, 4326, None, None]


def test_invalid_truths_and_written_outcomes(spark, tmp_path):
    crossed = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]
    truth = spark.createDataFrame([(1, "t1", square(0, 0)), (1, "t2", crossed), (1, "t3", square(50, 50))], f"source_id int, truth_id string, {POINTS}")
    predictions = spark.createDataFrame([(1, "p1", "boat", square(1, 0)), (1, "p2", "boat", square(90, 90)), (1, "p3", "house", square(50, 50))], f"source_id int, pred_id string, label string, {POINTS}")
    valid = evaluate.matchable(truth)
    assert {r.truth_id for r in valid.collect()} == {"t1", "t3"}
    matches = spark.createDataFrame([(1, "boat", "t1", "p1", 0.8), (1, "house", "t3", "p3", 1.0)], "source_id int, label string, truth_id string, pred_id string, iou double")
    r = evaluate.outcome_counts(truth, predictions, matches, valid=valid).first()
    assert (r.tp, r.fn, r.fp, r.total_truth, r.total_pred) == (2, 0, 1, 3, 3) and r.recall == 2 / 3 and r.fnr == 0
    none = evaluate.outcome_counts(truth, predictions.limit(0), matches.limit(0), valid=valid).first()
    assert (none.tp, none.fn, none.fp) == (0, 3, 0)
    found = evaluate.outcomes(valid, predictions, matches, ["source_id"], "label")
    expected = {("boat", "true_positives"): 1, ("boat", "false_negatives"): 1, ("boat", "false_positives"): 1, ("house", "true_positives"): 1, ("house", "false_negatives"): 1}
    assert {(r.label, r.outcome): r["count"] for r in found.groupBy("label", "outcome").count().collect()} == expected
    evaluate.write_outcomes(found, f"{tmp_path}/out", parts=3, epsg=32739)
    texts = spark.read.option("wholetext", False).text(f"{tmp_path}/out").withColumnRenamed("value", "content")
    back = geojson.parse_collections(texts, "content", "truth_id string, pred_id string")
    assert {(r.label, r.outcome): r["count"] for r in back.groupBy("label", "outcome").count().collect()} == expected
    assert {r.crs for r in back.collect()} == {"EPSG:32739"}
    assert evaluate.outcomes(valid, predictions, matches.drop("label"), ["source_id"]).count() == 3


def test_average_precision(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(rng.random(), 2), int(rng.random() < 0.6)) for _ in range(400)] + [("a", 1.0, 1), ("b", 0.0, 0)]
    support = [("a", 150), ("b", 140), ("c", 5), ("d", 0)]
    got = {r.label: r.average_precision for r in evaluate.average_precision(spark.createDataFrame(rows, "label string, conf double, hit int"), spark.createDataFrame(support, "label string, total_truth long"), buckets=16).collect()}
    for label, total in support:
        mine, expected, before = [x for x in rows if x[0] == label], 0.0, 0
        for conf in sorted({c for _, c, _ in mine}, reverse=True):
            upto = [h for _, c, h in mine if c >= conf]
            expected += (sum(upto) - before) / total * sum(upto) / len(upto)
            before = sum(upto)
        assert abs(got[label] - expected) < 1e-12
    metrics = spark.createDataFrame([("a", 0.5)], "label string, f1 double")
    assert sorted(map(tuple, evaluate.of_all_classes(metrics, spark.createDataFrame(support, "label string, n long")).collect())) == [("a", 0.5), ("b", 0.0), ("c", 0.0), ("d", 0.0)]


def test_merged_slices_are_those_of_one_loop(spark):
    rng = random.Random(4)
    rows = [(k % 2, f"d{k:02}", rng.choice(["boat", "house"]), round(rng.random(), 1), square(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(5, 15), rng.uniform(5, 15))) for k in range(80)]
    got = {r.det_id for r in inference.merge_sliced(spark.createDataFrame(rows, f"source_id int, det_id string, label string, conf double, {POINTS}")).collect()}

    def covered(p, q):
        w = min(p[2][0], q[2][0]) - max(p[0][0], q[0][0])
        h = min(p[2][1], q[2][1]) - max(p[0][1], q[0][1])
        size = lambda s: (s[2][0] - s[0][0]) * (s[2][1] - s[0][1])
        return w > 0 and h > 0 and w * h >= 0.5 * min(size(p), size(q))

    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(k[0] == r[0] and k[2] == r[2] and covered(k[4], r[4]) for k in kept):
            kept.append(r)
    assert got == {r[1] for r in kept} and len(got) < 80
    assert inference.merge_sliced(spark.createDataFrame(rows[:1], f"source_id int, det_id string, label string, conf double, {POINTS}")).count() == 1


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 3), None if k % 50 == 0 else float(v), float("nan") if k % 40 == 0 else float(w)) for k, (v, w) in enumerate(zip(rng.normal(0, 100, 900), rng.choice([0.0, 1.0, -1.0, 1e300, 5e-324, 7.5], 900)))] + [(None, 4.0, 2.0), (None, 8.0, 2.0), (7, None, None)]
    df = spark.createDataFrame(rows, "k int, v double, w double")
    got = {(r.k, r.name): (r.q1, r.q2, r.q3, r.q4) for r in quantiles.quantiles(df, ["k"], ["v", "w"], (0.0, 0.25, 0.5, 0.99)).collect()}
    for k in (0, 1, 2, None):
        for c, name in ((1, "v"), (2, "w")):
            values = [r[c] for r in rows if r[0] == k and r[c] is not None and not np.isnan(r[c])]
            assert np.allclose(got[k, name], np.quantile(values, (0.0, 0.25, 0.5, 0.99)), rtol=1e-12, atol=0)
    assert len(got) == 8
    boxes = spark.createDataFrame([(1, square(0, 0, 3.0, 4.0)), (1, square(0, 0, 5.0, 6.0)), (2, square(1, 1))], f"class_id int, {POINTS}")
    assert {r.class_id: (r.n, r.median_long, r.median_area) for r in report.size_stats(boxes).collect()} == {1: (2, 5.0, 21.0), 2: (1, 10.0, 100.0)}


def test_quadrilaterals_equal_polygons_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [([tuple(map(float, p)) for p in rng.uniform(-50, 50, (4, 2))],) for _ in range(200)] + [([(1.0, 1.0)] * 4,)]
    df = spark.createDataFrame(rows, POINTS)
    p = F.col("points")
    for r in df.select(*[F.struct(f(p).alias("a"), g(p).alias("b")).alias(f"c{k}") for k, (f, g) in enumerate(((Q.area, G.area), (Q.long_side, G.long_side), (Q.short_side, G.short_side), (Q.bounds, G.bounds), (Q.signed_area, G.signed_area)))]).collect():
        assert all(c.a == c.b for c in r)
    for r in df.select(Q.centroid(p).alias("a"), G.centroid(p).alias("b")).collect():
        assert np.allclose(r.a, r.b)


def test_totals_support_and_windows(spark):
    counts = spark.createDataFrame([(0, "train", 5), (0, "val", 1), (1, "test", 2)], "class_id int, split string, n long")
    assert sorted(map(tuple, report.with_total_row(report.class_pivot(counts)).collect()), key=str) == [(0, 5, 1, 0, 6), (1, 0, 0, 2, 2), (None, 5, 1, 2, 8)]
    assert sorted(map(tuple, report.support(counts, 3).collect())) == [(0, 2), (1, 1), (2, 0)]
    w = spark.range(1).select(tiling.context_window(F.lit(100), F.lit(5000)).alias("w"), tiling.tile_centre(*map(F.lit, (1.0, -3.0, 2.0, -1.0))).alias("c")).first()
    assert tuple(w.w) == (-900, 4000, 2000, 2000, 950, 950, 100) and tuple(w.c) == (1.5, -2.0)
    chips = spark.createDataFrame([(1, 7, 505.25, 1997.25)], "source_id int, chip int, x double, y double")
    sources = spark.createDataFrame([(1, (0.5, 0.0, 500.0, 0.0, -0.5, 2000.0))], "source_id int, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    r = tiling.chip_context(chips, sources, F.col("chip") == 7).first()
    assert (r.px, r.py, r.window.x_off) == (10, 5, -990) and tiling.chip_context(chips, sources, F.col("chip") == 8).count() == 0


def test_names_batches_places_and_bytes(spark):
    names = spark.createDataFrame([(0, "boat")], "class_id int, name string")
    assert sorted(r.name for r in labels.class_name(spark.createDataFrame([(0,), (3,)], "class_id int"), names).collect()) == ["boat", "class_3"]
    rows = tiling.batches(spark.createDataFrame([(k % 2, k) for k in range(11)], "s int, k int"), ["k"], 2, "s").collect()
    assert all(r.batch == r.k // 2 // 2 for r in rows)
    tiles = spark.createDataFrame([(1, (2.0, 0.0, 100.0, 0.0, -2.0, 50.0))], "tile_id int, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    found = inference.georeference(spark.createDataFrame([(1, [(3.0, 4.0)])], f"tile_id int, {POINTS}"), tiles, offset=0.5).first()
    assert tuple(found.points[0]) == (107.0, 41.0)
    shape = spark.createDataFrame([(square(0, 0),)], POINTS)
    meets = shape.select(*[G.intersects_box(F.col("points"), *map(F.lit, b)).alias(f"b{k}") for k, b in enumerate(((5.0, 5.0, 20.0, 20.0), (11.0, 0.0, 20.0, 5.0), (-5.0, -5.0, 50.0, 50.0)))]).first()
    assert tuple(meets) == (True, False, True)
    shown = spark.createDataFrame([([[[0.0, 5.0, 10.0, 20.0]]], 0.0, 10.0), ([[[3.0, 3.0]]], 3.0, 3.0)], "pixels array<array<array<double>>>, lo double, hi double").select(tiling.display_normalise(F.col("pixels"), F.col("lo"), F.col("hi")).alias("p")).collect()
    assert [r.p for r in shown] == [[[[0, 127, 255, 255]]], [[[3, 3]]]]
    assert inference.prepare(np.full((2, 2, 4), 100.0)).shape == (2, 2, 3) and inference.prepare(np.array([[[0.5]], [[1.0]]])).ravel().tolist() == [127, 255]
    wide = inference.prepare(np.arange(400, dtype=float).reshape(20, 20, 1))
    assert wide.min() == 0 and wide.max() == 255 and wide.dtype == np.uint8


def test_refined_detections_and_wanted_clusters(spark):
    df = spark.createDataFrame([(0, 0.5), (4, 0.9), (5, 0.7), (None, 0.8)], "cluster int, conf double")
    assert inference.refine(df) is df and inference.refine(df, F.col("conf") > 0.6).count() == 3
    assert sorted(r.cluster for r in cluster.of_clusters(df, range(5)).collect()) == [0, 4]


def test_settings(tmp_path):
    c = Config.of({"tiling": {"size": 512}, "model": {"prompts": ["boat"]}})
    assert c.tiling.size == 512 and c.tiling.overlap == 384 and c.model.prompts == ("boat",)
    c.write(f"{tmp_path}/c.json")
    assert Config.read(f"{tmp_path}/c.json") == c
    for wrong in ({"tyling": {}}, {"tiling": {"sice": 1}}):
        with pytest.raises(ValueError, match="unknown"):
            Config.of(wrong)
