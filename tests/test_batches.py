"""Measures of polygons in batches, and columns built on them."""

import numpy as np
from pyspark.sql import functions as F

from skymosaic.functions import batches
from skymosaic.functions import geometry as G

RING = "array<struct<x:double,y:double>>"


def test_cut_keeps_every_piece_of_a_concave_ring():
    # a comb of three teeth, cut where there are teeth only
    x = np.array([[0.0, 7, 7, 6, 6, 4, 4, 3, 3, 1, 1, 0]])
    y = np.array([[0.0, 0, 5, 5, 1, 1, 5, 5, 1, 1, 5, 5]])
    box = [np.array([v]) for v in (-1.0, 2.0, 8.0, 9.0)]
    assert batches.common_with_box(x, y, box)[0] == 9.0


def test_rows_of_any_size_and_nulls_in_one_batch(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(1, square), (2, None), (3, []), (4, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]), (5, [*square, square[0]]), (6, [square[0], *square]), (7, [(0.0, 0.0), (4.0, 0.0), (2.0, 1.0), (0.0, 4.0)])]
    df = spark.createDataFrame(rows, f"i int, r {RING}").repartition(1)
    got = {r.i: (r.s, r.u) for r in df.select("i", G.is_simple(F.col("r")).alias("s"), G.polygon_iou(F.col("r"), F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in square])).alias("u")).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: True, 2: None, 3: False, 4: False, 5: True, 6: True, 7: True}
    assert got[1][1] == got[5][1] == got[6][1] == 1.0 and got[4][1] == 0.0 and got[3][1] == 0.0 and got[2][1] is None and 0 < got[7][1] < 1


def test_rectangles_and_ious_work_on_batches(spark):
    """Both went through lambdas, corner by corner."""
    df = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)],)], f"r {RING}")
    for c in (G.min_rotated_rectangle(F.col("r")), G.polygon_iou(F.col("r"), F.col("r")), G.is_simple(F.col("r"))):
        assert "ArrowEvalPython" in df.select(c.alias("c"))._jdf.queryExecution().executedPlan().toString()
