"""Spatial joins work out rings and bounds once: no filter of a join repeats their terms below."""

from pyspark.sql import functions as F

from skymosaic.operators import spatial


def _rings(spark, name):
    at = lambda k: F.struct((F.sin("id") + k % 2).alias("x"), (F.sin("id") + k // 2).alias("y"))
    return spark.range(40).join(F.broadcast(spark.range(2).withColumnRenamed("id", "s")), F.col("id") % 2 == F.col("s")).select("s", F.col("id").alias(f"{name}_id"), F.array(*[at(k) for k in (0, 1, 3, 2)]).alias(f"{name}_points"))


def test_terms_are_not_repeated(spark):
    found = spatial.polygon_pairs(_rings(spark, "truth"), _rings(spark, "pred"), "s")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == 16
    assert found.filter("truth_id = pred_id and iou > 0.999").count() == 40


def test_bounds_are_not_repeated(spark):
    side = lambda name, box: spark.range(40).select(F.lit(1).alias("s"), F.col("id").alias(name), F.struct(*[(F.sin("id") + k).alias(c) for k, c in ((0, "x0"), (0, "y0"), (1, "x1"), (1, "y1"))]).alias(box))
    found = spatial.box_join(side("i", "lbox"), side("j", "rbox"), "s", most=None)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("SIN(") == 8
    assert found.filter("i = j").count() == 40
