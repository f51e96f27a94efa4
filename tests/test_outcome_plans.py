"""Outcomes for many labels shuffle each truth once, and their collections are made without a shuffle."""

from pyspark.sql import functions as F

from skymosaic.operators import evaluate
from skymosaic.sources import geojson

RING = "array<struct<x:double,y:double>>"


def test_outcomes_are_packed_where_they_lie(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.5)]
    truth = spark.createDataFrame([(1, "a", ring), (1, "b", ring), (2, "a", ring), (None, "n", ring)], f"s int, truth_id string, points {RING}")
    predictions = spark.createDataFrame([(1, "l", "p", ring), (1, "m", "p", ring), (2, "l", "q", ring), (2, None, "r", ring)], f"s int, label string, pred_id string, points {RING}")
    matches = spark.createDataFrame([(1, "l", "a", "p"), (2, "l", "a", "q")], "s int, label string, truth_id string, pred_id string")
    found = evaluate.outcomes(truth, predictions, matches, ["s"], "label")
    rows = {(r.label, r.outcome, r.properties.s, r.properties.truth_id, r.properties.pred_id) for r in found.collect()}
    tp = {("l", "true_positives", 1, "a", "p"), ("l", "true_positives", 2, "a", "q")}
    fp = {("m", "false_positives", 1, None, "p"), (None, "false_positives", 2, None, "r")}
    every = [(1, "a"), (1, "b"), (2, "a"), (None, "n")]
    fn = {(label, "false_negatives", s, t, None) for label in ("l", "m", None) for s, t in every if (label, s, t) not in {("l", 1, "a"), ("l", 2, "a")}}
    assert rows == tp | fp | fn and found.count() == len(rows)

    texts = geojson.packed_collections(found, ["label", "outcome"], name="boats", epsg=32739)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    assert shuffles(texts) == shuffles(found.select("*"))
    back = geojson.parse_collections(texts, "content", "s int, truth_id string, pred_id string")
    told = back.select("label", "outcome", "properties.*", F.size("points").alias("n"), "crs").collect()
    assert {tuple(r)[:5] for r in told} == rows and len(told) == len(rows) and {(r.n, r.crs) for r in told} == {(3, "EPSG:32739")}
    one = found.filter("outcome = 'true_positives'").coalesce(1)
    (a,), (b,) = (f(one, ["label", "outcome"]).collect() for f in (geojson.packed_collections, geojson.collections))
    assert len(a.content) == len(b.content) and a.content[:60] == b.content[:60]
