"""Spatial joins as equi-joins on source and grid cell, refined by bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import quads as Q
from ..functions.batches import area_in_box, shared_area
from ..functions.geometry import area, bounds, clip_to_box, is_simple, signed_area
from ..functions.repair import repair
from . import quadtree
from .labels import remap


def box_join(left: DataFrame, right: DataFrame, key: str, size: float = 384.0, most: int | None = 100_000, depth: int = 5) -> DataFrame:
    """Pairs of equal `key` whose boxes `lbox` and `rbox` (struct x0,y0,x1,y1) meet; no pair twice.

    Both sides are dealt to grid cells of `size`; a pair is kept in the cell that holds the lowest corner of what both boxes
    share, so there is no distinct. Cells that more than `most` boxes meet are split in four, `depth` times at most, where
    their load says that this helps, else salted (`quadtree.crowded`); None leaves the grid as it is.
    """
    a, b = left, right.withColumnRenamed(key, "__key")
    plan = quadtree.crowded(a.select(F.col(key).alias("key"), F.col("lbox").alias("box")), b.select(F.col("__key").alias("key"), F.col("rbox").alias("box")), size, most, depth) if most else []
    a, b = quadtree.dealt(a, key, "lbox", size, plan, "left"), quadtree.dealt(b, "__key", "rbox", size, plan, "right", "__cell")
    on = (F.col(key) == F.col("__key")) & (F.col("cell.cx") == F.col("__cell.cx")) & (F.col("cell.cy") == F.col("__cell.cy"))
    if plan:
        on = on & (F.col("cell.level") == F.col("__cell.level")) & (F.col("cell.l") == F.col("__cell.l")) & (F.col("cell.r") == F.col("__cell.r"))
    meet = (F.col("lbox.x0") <= F.col("rbox.x1")) & (F.col("rbox.x0") <= F.col("lbox.x1")) & (F.col("lbox.y0") <= F.col("rbox.y1")) & (F.col("rbox.y0") <= F.col("lbox.y1"))
    level = F.col("cell.level") if plan else 0
    first = (F.col("cell.cx") == quadtree.place(F.greatest("lbox.x0", "rbox.x0"), size, level)) & (F.col("cell.cy") == quadtree.place(F.greatest("lbox.y0", "rbox.y0"), size, level))
    return a.join(b, on & meet & first).drop("cell", "__cell", "__key")


def tile_annotation_join(tiles: DataFrame, annotations: DataFrame, least_visible: float = 0.25, size: float = 384.0, keep_all: bool = False, quads: bool = False, most: int | None = 100_000) -> DataFrame:
    """Tiles with the annotations of which at least a share is visible; `clip` is the visible polygon.

    tiles: source_id, x_off, y_off, tw, th; annotations: source_id, points. `keep_all` also keeps what shows less. With
    `quads` every annotation has four corners, so bounds and whole areas are compiled. Only pairs that cross an edge are cut,
    and only at the sides that they cross.
    """
    t = tiles.withColumn("lbox", F.struct(F.col("x_off").cast("double").alias("x0"), F.col("y_off").cast("double").alias("y0"), (F.col("x_off") + F.col("tw")).cast("double").alias("x1"), (F.col("y_off") + F.col("th")).cast("double").alias("y1")))
    a = annotations.withColumns({"rbox": (Q.bounds if quads else bounds)(F.col("points")), "full": (Q.area if quads else area)(F.col("points"))})
    pairs = box_join(t, a, "source_id", size, most)
    inside = (F.col("rbox.x0") >= F.col("lbox.x0")) & (F.col("rbox.x1") <= F.col("lbox.x1")) & (F.col("rbox.y0") >= F.col("lbox.y0")) & (F.col("rbox.y1") <= F.col("lbox.y1"))
    clip = F.when(inside, F.col("points")).otherwise(clip_to_box(F.col("points"), F.col("lbox.x0"), F.col("lbox.y0"), F.col("lbox.x1"), F.col("lbox.y1"), F.col("rbox")))
    shown = area_in_box(F.when(~inside, F.col("points")), *[F.col("lbox")[f] for f in ("x0", "y0", "x1", "y1")])
    visible = F.when(F.col("full") > 0, F.when(inside, F.lit(1.0)).otherwise(shown / F.col("full"))).otherwise(F.lit(0.0))
    told = pairs.select("*", clip.alias("clip"), visible.alias("visible"))  # the clip is cut where it is read
    return (told if keep_all else told.filter(F.col("visible") >= least_visible)).drop("lbox", "rbox", "full")


def counted_join(tiles: DataFrame, annotations: DataFrame, least_visible: float = 0.25, quads: bool = False, size: float = 384.0, class_col: str = "class_raw") -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Labels of raw annotations (`class_raw`, points), and what was dropped on the way, counted in the same pass.

    The second result is called once a job has used all labels, and gives the numbers of annotations read, dropped for their
    class and for a ring without area, and of pairs met, kept, dropped as hardly visible, and of those that only touch.
    Counters are those of the first job that finishes.
    """
    before, after = Observation(), Observation()
    known = annotations.withColumns({"class_id": remap(F.col(class_col)), "__area": (Q.area if quads else area)(F.col("points"))})
    wanted, sound = F.col("class_id").isNotNull(), F.col("__area") > 0
    n = lambda c, name: F.count_if(c).alias(name)
    known = known.observe(before, F.count("*").alias("read"), n(~wanted, "dropped_class"), n(wanted & ~F.coalesce(sound, F.lit(False)), "dropped_geometry")).filter(wanted & sound).drop("__area")
    pairs = tile_annotation_join(tiles, known, least_visible, size, keep_all=True, quads=quads, most=None)
    shown = F.col("visible") >= least_visible
    pairs = pairs.observe(after, F.count("*").alias("pairs"), n(shown, "kept"), n(~shown, "dropped_visible"), n(F.col("visible") == 0, "touching"))
    return pairs.filter(shown), lambda: {**before.get, **after.get}


def polygon_pairs(truth: DataFrame, predictions: DataFrame, key: str, size: float = 384.0, most: int | None = 100_000) -> DataFrame:
    """Pairs whose bounds meet and their `iou`; truth: truth_points, predictions: pred_points, rings of any number of corners.

    A ring that bounds no valid polygon has IoU 0 with everything.
    """
    return shared_pairs(truth, predictions, key, size, most).drop("common", "truth_area", "pred_area")


def repaired_pairs(truth: DataFrame, predictions: DataFrame, key: str, size: float = 384.0, rule: str = "odd", most: int | None = 100_000) -> DataFrame:
    """(key, truth_id, pred_id, iou) of truths of which invalid rings are repaired first; see `functions.repair`.

    truth: key, truth_id, truth_points; predictions: key, pred_id, pred_points. A repaired truth is a set of rings, of which
    holes count against the others; only invalid rings go through the repair. Truths that keep no area are in no pair.
    """
    truth = truth.select(key, "truth_id", "truth_points", is_simple(F.col("truth_points")).alias("__valid"))
    whole = truth.filter("__valid").select(key, "truth_id", "truth_points", F.lit(1.0).alias("__sign"))
    pieces = truth.filter("not __valid").select(key, "truth_id", F.explode(repair(F.col("truth_points"), rule)).alias("truth_points"))
    pieces = pieces.withColumn("__sign", F.signum(signed_area(F.col("truth_points"))))
    rings = whole.unionByName(pieces)
    shared = shared_pairs(rings, predictions.select(key, "pred_id", "pred_points"), key, size, most)
    found = shared.groupBy(key, "truth_id", "pred_id").agg(F.sum(F.col("__sign") * F.col("common")).alias("common"), F.max("pred_area").alias("pred_area"))
    full = rings.groupBy(key, "truth_id").agg(F.sum(F.col("__sign") * area(F.col("truth_points"))).alias("full"))
    union = F.col("full") + F.col("pred_area") - F.col("common")
    iou = F.when(union > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("common") / union))).otherwise(F.lit(0.0))
    return found.join(full, [key, "truth_id"]).select(key, "truth_id", "pred_id", iou.alias("iou"))


def shared_pairs(truth: DataFrame, predictions: DataFrame, key: str, size: float = 384.0, most: int | None = 100_000) -> DataFrame:
    """Pairs whose bounds meet, their areas, what they have in `common` and their `iou`.

    Pairs are cut together in Arrow batches; rings that bound no valid polygon have nothing in common with others.
    """

    def told(df: DataFrame, name: str, box: str) -> DataFrame:
        """Bounds and area go with a row, so that they are worked out once, not for every pair. Rings without points have null bounds, which meet no cell."""
        points = F.col(f"{name}_points")
        return df.withColumns({box: _either(points, Q.bounds, bounds), f"{name}_area": _either(points, Q.area, area)})

    pairs = box_join(told(truth, "truth", "lbox"), told(predictions, "pred", "rbox"), key, size, most)
    pairs = pairs.withColumn("common", shared_area(F.col("truth_points"), F.col("pred_points")))
    union = F.col("truth_area") + F.col("pred_area") - F.col("common")
    return pairs.withColumn("iou", F.when(union > 0, F.least(F.lit(1.0), F.col("common") / union)).otherwise(F.lit(0.0))).drop("lbox", "rbox")


def _either(points: Column, of_four: Callable, of_any: Callable) -> Column:
    """A measure by compiled arithmetic where there are four corners."""
    return F.when(F.size(points) == 4, of_four(points)).otherwise(of_any(points))
