"""Tiling of rasters and pixel mathematics on tile rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, invert_affine, let
from .quantiles import quantiles


def tile_grid(sources: DataFrame, size: int = 768, overlap: int = 384, width: str = "w", height: str = "h") -> DataFrame:
    """One row a tile: offsets at multiples of size - overlap while inside, sizes cut at the right and lower edge."""
    stride = size - overlap
    steps = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / stride) - 1)
    grid = sources.withColumn("i", F.explode(steps(width))).withColumn("j", F.explode(steps(height)))
    x, y = F.col("i") * stride, F.col("j") * stride
    return grid.select("*", x.alias("col_off"), y.alias("row_off"), F.least(F.lit(size), F.col(width) - x).alias("tile_width"), F.least(F.lit(size), F.col(height) - y).alias("tile_height"))


def select_bands(bands: Column, wanted: Sequence[int] | None = None) -> Column:
    """Three bands: those asked for (1-based), else the first three, else the first one three times."""
    if wanted:
        return F.array(*[F.element_at(bands, k) for k in wanted])
    return F.when(F.size(bands) >= 3, F.slice(bands, 1, 3)).otherwise(F.array_repeat(F.element_at(bands, 1), 3))


def pad(pixels: Column, width: int, height: int) -> Column:
    """Rows of pixels filled with zeros at the right and below."""
    zero = F.lit(0).cast("double")
    wide = F.transform(pixels, lambda r: F.concat(r, F.array_repeat(zero, F.lit(width) - F.size(r))))
    return F.concat(wide, F.array_repeat(F.array_repeat(zero, width), F.lit(height) - F.size(pixels)))


def window_of(pixels: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """A window that may reach beyond the picture: what lies outside is 0."""
    zero = F.lit(0).cast("double")
    row = lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(r, (x + i).cast("int")), zero))
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda j: row(F.coalesce(F.get(pixels, (y + j).cast("int")), F.array().cast("array<double>"))))


def is_constant(pixels: Column) -> Column:
    """Whether all samples of all bands (array of bands of rows) are one value: such tiles are skipped."""
    return let(F.flatten(F.flatten(pixels)), lambda p: F.array_min(p) == F.array_max(p))


def limits(samples: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Linearly interpolated percentiles of each image and band, by bins counted before the shuffle; nulls and NaN do not count."""
    found = quantiles(samples, keys, [value], (low, high))
    return found.select(*keys, F.col("q1").alias("lo"), F.col("q2").alias("hi"))


def stretch(value: Column, lo: Column, hi: Column) -> Column:
    """0 to 255, held within 1..254 and cut to a whole number; 0 where an image is flat."""
    share = F.try_divide(value - lo, hi - lo) * 255.0
    return F.when(hi == lo, F.lit(0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(254.0), share)).cast("int"))


def display_normalise(pixels: Column, lo: Column, hi: Column) -> Column:
    """All channels by common percentiles into 0..255; flat images are only cut to bytes."""
    one = lambda v: F.when(hi == lo, v.cast("int")).otherwise((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - lo, hi - lo))) * 255).cast("int"))
    return F.transform(pixels, lambda band: F.transform(band, lambda row: F.transform(row, one)))


def square_chips(annotations: DataFrame, points: str = "points", chip: int = 224, resolution: float = 1.0) -> DataFrame:
    """Adds the square around each annotation's bounds and the scale that brings it to `chip` pixels (0 for a point)."""
    b = annotations.withColumn("b", bounds(F.col(points)))
    w, h = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    b = b.withColumns({"width": w, "height": h, "side": F.greatest(w, h), "mid_x": (F.col("b.x0") + F.col("b.x1")) / 2, "mid_y": (F.col("b.y0") + F.col("b.y1")) / 2})
    half = F.col("side") / 2
    scale = F.when(F.col("side") > 0, F.lit(float(chip)) / (F.col("side") / resolution)).otherwise(F.lit(0.0))
    return b.withColumns({"min_x": F.col("mid_x") - half, "min_y": F.col("mid_y") - half, "max_x": F.col("mid_x") + half, "max_y": F.col("mid_y") + half, "scale": scale}).drop("b")


def batches(df: DataFrame, order: Sequence[str], size: int, key: str) -> DataFrame:
    """Numbers batches of `size` rows inside each `key`."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def tile_centre(west: Column, south: Column, east: Column, north: Column) -> Column:
    """struct<lon,lat> of the middle of a tile's bounds."""
    return F.struct(((east + west) / 2).alias("lon"), ((north + south) / 2).alias("lat"))


def context_window(x: Column, y: Column, size: int = 2000, box: int = 100) -> Column:
    """struct of the window of `size` pixels around a pixel, which may reach beyond the picture, and the box drawn in its middle."""
    left, top, inner = x - size // 2, y - size // 2, (size - box) // 2
    fields = {"x_off": left, "y_off": top, "width": F.lit(size), "height": F.lit(size), "box_x": F.lit(inner), "box_y": F.lit(inner), "box_size": F.lit(box)}
    return F.struct(*[c.cast("long").alias(k) for k, c in fields.items()])


def chip_context(chips: DataFrame, sources: DataFrame, row: Column, size: int = 2000, key: str = "source_id") -> DataFrame:
    """The picked chips (`row`: condition) with the pixel of their place in the source and the window around it.

    chips: key, lon and lat in the source's system as x and y; sources: key, transform (struct a..f, pixels to places).
    """
    picked = chips.filter(row).join(sources.select(key, "transform"), key)
    at = invert_affine(F.col("transform"), F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"))))
    pixel = picked.withColumn("__p", F.element_at(at, 1)).withColumns({"px": F.floor("__p.x"), "py": F.floor("__p.y")}).drop("__p", "transform")
    return pixel.withColumn("window", context_window(F.col("px"), F.col("py"), size))
