"""Counts, sizes and training curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quads import area, long_side, short_side
from .quantiles import quantiles


def class_pivot(counts: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Rows of classes and columns of splits from (class_id, split, n), missing cells 0, with a total a row."""
    out = counts.groupBy("class_id").pivot("split", list(splits)).agg(F.sum("n")).na.fill(0)
    return out.withColumn("total", sum(F.col(s) for s in splits))


def with_total_row(pivot: DataFrame, key: str = "class_id") -> DataFrame:
    """`pivot` and a row of its columns' sums, whose key is null."""
    sums = pivot.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(pivot.schema[c].dataType).alias(c) for c in pivot.columns if c != key])
    return pivot.unionByName(sums.withColumn(key, F.lit(None).cast(pivot.schema[key].dataType)).select(*pivot.columns))


def support(labels: DataFrame, n_classes: int, cls: str = "class_id") -> DataFrame:
    """(class_id, support) of the classes 0 .. n_classes - 1, 0 where none has a label."""
    dense = labels.sparkSession.range(n_classes).select(F.col("id").cast(labels.schema[cls].dataType).alias(cls))
    return dense.join(labels.groupBy(cls).agg(F.count("*").alias("support")), cls, "left").na.fill(0, ["support"])


def class_totals(labels: DataFrame, keys: Sequence[str] = ("split", "class_id")) -> DataFrame:
    """Counts with all subtotals; nulls mark what is summed over."""
    return labels.rollup(*keys).agg(F.count("*").alias("n"))


def tiles_per_split(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("split").agg(F.count("*").alias("tiles"), F.count_if(F.col("n_labels") > 0).alias("annotated"))


def size_stats(boxes: DataFrame, keys: Sequence[str] = ("class_id",), points: str = "points", classes: Sequence[int] | None = None, cls: str = "class_id") -> DataFrame:
    """Count, mean and population deviation of sides, mean area, mean of ratios, exact medians; points: four corners. With `classes`, of those only."""
    p = F.col(points)
    boxes = boxes if classes is None else boxes.filter(F.col(cls).isin(*classes))
    sized = boxes.select(*keys, long_side(p).alias("long"), short_side(p).alias("short"), area(p).alias("area"))
    ratio = F.when(F.col("short") > 0, F.col("long") / F.when(F.col("short") > 0, F.col("short")))
    means = sized.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("long").alias("mean_long"), F.stddev_pop("long").alias("std_long"), F.avg("short").alias("mean_short"), F.stddev_pop("short").alias("std_short"),
        F.avg("area").alias("mean_area"), F.avg(ratio).alias("mean_ratio"),
    )
    medians = quantiles(sized, keys, ("long", "area"), (0.5,)).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, F.col("q1"))).alias(f"median_{c}") for c in ("long", "area")])
    same = [means[k].eqNullSafe(medians[k]) for k in keys]
    return means.join(medians, same, "left").select(*[means[k] for k in keys], *means.columns[len(keys) :], "median_long", "median_area")


def training_stats(log: DataFrame, epoch: str = "epoch", time: str = "time", up: str = "up", up_wide: str = "up_wide", loss: str = "loss") -> DataFrame:
    """One row: epoch of the best `up` (first on ties), greatest `up_wide`, 1-based place of the least loss, divergence of the last loss in percent, minutes an epoch."""
    numbered = log.withColumn("place", F.row_number().over(Window.orderBy(epoch)))  # a training log has one row an epoch
    first, last = F.min_by(F.col(time), F.col(epoch)), F.max_by(F.col(time), F.col(epoch))
    least = F.min(loss)
    return numbered.agg(
        F.min(F.struct((-F.col(up)).alias("m"), F.col(epoch).alias("e"))).getField("e").alias("best_epoch"), F.max(up).alias("best_up"), F.max(up_wide).alias("best_up_wide"),
        F.min(F.struct(F.col(loss).alias("m"), F.col("place").alias("p"))).getField("p").alias("least_loss_place"),
        F.when(least == 0, F.lit(0.0)).otherwise((F.max_by(loss, epoch) - least) / F.when(least == 0, F.lit(1.0)).otherwise(least) * 100).alias("divergence"),
        F.count("*").alias("epochs"), F.when(F.count("*") > 1, (last - first) / F.when(F.count("*") > 1, F.count("*") - 1).otherwise(1) / 60).alias("minutes_per_epoch"),
    )
