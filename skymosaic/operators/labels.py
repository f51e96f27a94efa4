"""Class remapping, label rows and their text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quads as Q
from ..functions.geometry import area, scaled

# Raw class to trained class; other classes are not trained on.
CLASS_MAP = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4}
LEAST_AREA = 1e-9


def remap(raw: Column, classes: dict[int, int] = CLASS_MAP) -> Column:
    """Null for classes outside the map, and for null."""
    known = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.when(raw.isin(*classes), F.element_at(known, raw))


def of_classes(annotations: DataFrame, wanted: Sequence[int] = (0, 2), column: str = "class_raw") -> DataFrame:
    """Annotations of the wanted classes; all of them where the table has no such column, as tables without classes are taken whole."""
    return annotations.filter(F.col(column).isin(*wanted)) if column in annotations.columns else annotations


def keep_trained(annotations: DataFrame, raw: str = "class_raw", classes: dict[int, int] = CLASS_MAP) -> DataFrame:
    """Filters first, so that geometry is worked out for what stays only."""
    return annotations.filter(F.col(raw).isin(*classes)).withColumn("class_id", remap(F.col(raw), classes))


def class_name(df: DataFrame, names: DataFrame, class_id: str = "class_id") -> DataFrame:
    """`names`: class_id, name. Unknown ones are called class_<id>."""
    joined = df.join(names.withColumnRenamed("class_id", "__id"), F.col(class_id) == F.col("__id"), "left").drop("__id")
    return joined.withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col(class_id).cast("string"))))


def to_label_rows(pairs: DataFrame, size: float = 768.0, quads: bool = False) -> DataFrame:
    """Corners relative to the tile, divided by the padded tile size and not clipped; slivers go. `quads`: all have four corners."""
    if quads:
        corner = lambda k: F.struct(((F.col("points")[k]["x"] - F.col("x_off")) / size).alias("x"), ((F.col("points")[k]["y"] - F.col("y_off")) / size).alias("y"))
        return pairs.withColumn("corners", F.array(*[corner(k) for k in range(4)])).filter(Q.area(F.col("corners")) >= LEAST_AREA)
    local = F.transform(F.col("points"), lambda p: F.struct((p["x"] - F.col("x_off")).alias("x"), (p["y"] - F.col("y_off")).alias("y")))
    return pairs.withColumn("corners", scaled(local, size)).filter(area(F.col("corners")) >= LEAST_AREA)


def label_line(class_id: Column, corners: Column) -> Column:
    number = lambda v: F.format_string("%.6f", v)
    return F.concat_ws(" ", class_id.cast("string"), F.flatten(F.transform(corners, lambda p: F.array(number(p["x"]), number(p["y"])))))


def parse_lines(text: Column) -> Column:
    """array<struct<class_id,corners>> of a label file's text; blank and malformed lines go."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    parts = F.transform(lines, lambda s: F.split(s, r"\s+"))
    whole = F.filter(parts, lambda p: (F.size(p) == 9) & F.forall(p, lambda v: v.try_cast("double").isNotNull()))
    corner = lambda p, k: F.struct(F.element_at(p, 2 * k + 2).cast("double").alias("x"), F.element_at(p, 2 * k + 3).cast("double").alias("y"))
    return F.transform(whole, lambda p: F.struct(F.element_at(p, 1).cast("double").cast("int").alias("class_id"), F.array(*[corner(p, k) for k in range(4)]).alias("corners")))


def with_background(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Every tile with `n_labels` (0: background) and `content`, its label file's text; labels: tile_id, line."""
    by_tile = labels.groupBy("tile_id").agg(F.count("*").alias("n_labels"), F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("content"))
    return tiles.join(by_tile, "tile_id", "left").withColumns({"n_labels": F.coalesce("n_labels", F.lit(0)), "content": F.coalesce("content", F.lit(""))})


def is_background(content: Column) -> Column:
    return F.trim(F.coalesce(content, F.lit(""))) == ""


def excluded_classes(class_id: Column, keep: list[int]) -> Column:
    """What a detector is told to keep: ids under 100 that are listed, and all from 100 on."""
    return (class_id >= 100) | class_id.isin(*keep)
