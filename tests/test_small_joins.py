"""Silhouettes by streamed tables, filters on columns that may lack, pairs of files by their paths, listings, and percentiles."""

import time

import numpy as np
from pyspark.sql import functions as F

from skymosaic.operators import cluster, labels, report, tiling
from skymosaic.sources import tables
from skymosaic.streaming import incremental


def test_silhouette_of_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 6))
    x[::3] += 3
    own = np.array([0 if k % 3 == 0 else 1 + (k % 2) for k in range(300)])
    own[7], x[8] = 9, x[11]
    df = spark.createDataFrame([(k, x[k].tolist(), int(own[k])) for k in range(300)] + [(999, None, 1), (998, x[0].tolist(), None)], "id int, v array<double>, label int").repartition(5)
    found = cluster.silhouette(df, "id", "v", "label", block=64)
    got = {r.id: r.silhouette for r in found.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k in range(300):
        mine = (own == own[k]) & (np.arange(300) != k)
        a = d[k, mine].mean() if mine.any() else None
        b = min(d[k, own == c].mean() for c in set(own.tolist()) - {int(own[k])})
        assert abs(got[k] - (0.0 if a is None else (b - a) / max(a, b))) < 1e-9
    assert len(got) == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no vector is repeated


def test_distances_by_products_keep_their_digits():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 64))
    x[40:80] = x[:40]  # copies
    x[80:120] = x[:40] + rng.normal(0, 1e-7, (40, 64))
    x[120] = 0
    x[121:130] *= 1e6
    x[130, 3], x[131, 4], x[132, 5] = np.inf, -np.inf, np.nan
    with np.errstate(all="ignore"):
        exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        found = cluster.distances(x, x)
        error = np.abs(found - exact)
    assert np.array_equal(np.isfinite(exact), np.isfinite(found)) and np.array_equal(np.isnan(exact), np.isnan(found))
    some = np.isfinite(exact)
    assert (error[some] <= 1e-9 * exact[some]).all() and (found[range(40), range(40, 80)] == 0).all()
    big, took = rng.normal(0, 1, (2_048, 64)), []
    for _ in range(3):
        began = time.perf_counter()
        cluster.distances(big, big)
        took.append(time.perf_counter() - began)
    assert min(took) < 0.8  # by differences: about 1.6 s


def test_silhouette_shuffles_no_sums(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 5)) + 1e6  # far from the origin
    x[50:60] = x[0]
    df = spark.createDataFrame([(k, x[k].tolist(), k % 7) for k in range(200)], "id int, v array<double>, label int").repartition(3)
    found = cluster.silhouette(df, "id", "v", "label", block=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # a task returns a row a vector, not one for each label
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own, got = np.arange(200) % 7, {r.id: r.silhouette for r in found.collect()}
    for k in range(200):
        a = d[k, own == own[k]].sum() / ((own == own[k]).sum() - 1)
        b = min(d[k, own == c].mean() for c in range(7) if c != own[k])
        assert abs(got[k] - (b - a) / max(a, b)) < 1e-9


def test_filters_on_columns_that_may_lack(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "class_raw int")
    assert labels.of_classes(df).count() == 2 and labels.of_classes(df.withColumnRenamed("class_raw", "other")).count() == 4
    boxes = df.select(F.col("class_raw").alias("class_id"), F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))]).alias("points"))
    assert [r.class_id for r in report.size_stats(boxes, classes=[0]).collect()] == [0] and report.size_stats(boxes).count() == 4


def test_files_by_their_paths(spark, tmp_path):
    for name in ("a/one.tif", "a/two.tif", "b/one.tif", "a/one.geojson", "b/one.geojson", "b/three.geojson"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    pictures, notes = tables.list_files(spark, str(tmp_path), "*.tif"), tables.list_files(spark, str(tmp_path), "*.geojson")
    short = lambda p: p.split(f"{tmp_path.name}/")[1]
    assert {(short(r.picture), short(r.annotation)) for r in tables.paired(pictures, notes).collect()} == {("a/one.tif", "a/one.geojson"), ("b/one.tif", "b/one.geojson")}
    rows = spark.createDataFrame([("a/one.tif",), ("./b/one.tif",), ("c/none.tif",), (None,)], "path string")
    assert {r.path for r in incremental.with_files(rows, str(tmp_path), "path").collect()} == {"a/one.tif", "./b/one.tif"}
    assert {r.path for r in incremental.with_files(rows, f"file://{tmp_path}/", "path", there=False).collect()} == {"c/none.tif", None}
    assert incremental.with_files(rows, str(tmp_path / "nowhere"), "path").count() == 0 and incremental.with_files(rows, str(tmp_path / "nowhere"), "path", False).count() == 4


def test_percentiles_of_samples(spark):
    rng = np.random.default_rng(2)
    x = {k: rng.integers(0, 65_536, 5_000).astype(float) for k in "ab"}
    df = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [("a", None), ("c", 5.0)], "image string, v double")
    got = {r.image: (r.lo, r.hi) for r in tiling.limits(df, ["image"], "v").collect()}
    for k in "ab":
        assert np.allclose(got[k], np.percentile(x[k], (1, 99)))
    assert got["c"] == (5.0, 5.0)
