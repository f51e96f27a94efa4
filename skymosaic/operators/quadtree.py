"""Grid cells that split where they are crowded: the plan that spatial joins deal their rows by.

A cell of level l has the side size / 2^l; a cell of one level is four cells of the next. `crowded` counts, level by level and
only below cells that are crowded, how many boxes of either side meet each cell. A crowded cell is split if its quarters
together have fewer pairs to test, or hardly more rows; if not (the boxes are larger than the quarters, or lie all in one
place), or where the last level is reached, it is salted instead: each side's rows are dealt over as many salts as they need and
repeated for each salt of the other side, so that every pair meets once. The first count is of rows a key, so data without
a crowded key costs one small aggregate.

What a plan holds is a row for each crowded cell, at most a few for every `most` rows of input; up to BROADCAST rows it is
broadcast, beyond that it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of a plan's table (about 60 bytes each) up to which it is broadcast.
BROADCAST = 100_000
#: A split is worth it if the quarters have this share of the cell's pairs left at most, or so many times its rows.
WORTH, MORE = 0.75, 1.25


def place(v: Column, size: float, level: Column | int = 0) -> Column:
    """Index of the cell of a level that a coordinate lies in; scaling by powers of two is exact, so levels nest."""
    scaled = v / F.lit(float(size))
    return F.floor(scaled if isinstance(level, int) and level == 0 else scaled * F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(float(level))))


def cells(box: Column, size: float, level: int = 0, within: tuple[Column, Column] | None = None) -> Column:
    """array<struct<cx,cy>> of the cells of a level that a box meets, its edges included; `within` a cell of the level before, if given."""

    def along(low: Column, high: Column, parent: Column | None) -> Column:
        a, b = place(low, size, level), place(high, size, level)
        return F.sequence(a, b) if parent is None else F.sequence(F.greatest(a, parent * 2), F.least(b, parent * 2 + 1))

    xs, ys = along(box["x0"], box["x1"], within and within[0]), along(box["y0"], box["y1"], within and within[1])
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def _counts(sides: DataFrame) -> DataFrame:
    """(key, cx, cy, l, r) from rows (key, side) with a cell."""
    side = lambda s: F.count_if(F.col("side") == s)
    return sides.groupBy("key", "cx", "cy").agg(side("left").alias("l"), side("right").alias("r"))


def crowded(left: DataFrame, right: DataFrame, size: float, most: int, depth: int = 5) -> list[tuple[DataFrame, int]]:
    """For each level from 0 on (table, its rows) of crowded cells: key, cx, cy, and the salts l and r of either side; null where the cell is split.

    left, right: key, box.
    """
    per_key = left.select("key").unionByName(right.select("key")).groupBy("key").count().filter(F.col("count") > most)
    sides = left.select("key", "box", F.lit("left").alias("side")).unionByName(right.select("key", "box", F.lit("right").alias("side")))
    full = checkpointed(per_key.select("key"))
    n = full.count()
    if not n:
        return []
    here = sides.join(few(full, n), "key", "left_semi").withColumn("cell", F.explode(cells(F.col("box"), size))).select("key", "side", "box", "cell.*")
    load = lambda a, b: F.col(a) * F.col(b)
    found = checkpointed(_counts(here).filter(F.col("l") + F.col("r") > most))
    plan: list[tuple[DataFrame, int]] = []
    for level in range(depth + 1):
        n = found.count()
        if not n:
            break
        salts = [F.ceil(F.col(c) / most).cast("int").alias(c) for c in ("l", "r")]
        if level == depth:
            plan.append((checkpointed(found.select("key", "cx", "cy", *salts)), n))
            break
        here = here.join(few(found.select("key", "cx", "cy"), n), ["key", "cx", "cy"], "left_semi")
        below = here.withColumn("cell", F.explode(cells(F.col("box"), size, level + 1, (F.col("cx"), F.col("cy"))))).select("key", "side", "box", "cell.*")
        quarters = checkpointed(_counts(below))
        parent = [F.floor(F.col(c) / 2).alias(c) for c in ("cx", "cy")]
        rows = F.col("l") + F.col("r")
        summed = quarters.select("key", *parent, load("l", "r").alias("p"), rows.alias("n")).groupBy("key", "cx", "cy").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        told = found.join(summed, ["key", "cx", "cy"])
        worth = (load("l", "r") > 0) & ((F.col("p") <= WORTH * load("l", "r")) | (F.col("n") <= MORE * rows))
        told = checkpointed(told.select("key", "cx", "cy", *[F.when(~worth, s).alias(c) for s, c in zip(salts, ("l", "r"))]))
        plan.append((told, n))
        split = told.filter("l is null").select("key", "cx", "cy")
        inside = quarters.withColumns({"px": F.floor(F.col("cx") / 2), "py": F.floor(F.col("cy") / 2)})
        inside = inside.join(few(split.withColumnsRenamed({"cx": "px", "cy": "py"}), n), ["key", "px", "py"], "left_semi").drop("px", "py")
        found = checkpointed(inside.filter(F.col("l") + F.col("r") > most))
        here = below
    return plan


def dealt(df: DataFrame, key: str, box: str, size: float, plan: list[tuple[DataFrame, int]], side: str, name: str = "cell") -> DataFrame:
    """`df` once for each cell that its box meets, in the column `name`: struct cx, cy, and with a plan level and salts l and r.

    The box is exploded from an array of one, too: a join's filters on it then stay above what works it out. Pushed below,
    they would repeat its terms until the compiled method is too large for the JVM to compile further.
    """
    out = df.withColumn(box, F.explode(F.array(box))).select(*df.columns).withColumn(name, F.explode(cells(F.col(box), size)))
    if not plan:
        return out
    columns = df.columns
    c = F.col(name)
    out = out.select(*columns, F.struct(F.lit(0).alias("level"), c["cx"].alias("cx"), c["cy"].alias("cy"), F.lit(0).alias("l"), F.lit(0).alias("r")).alias(name))
    salt = F.xxhash64(*[F.col(f"`{x}`") for x in columns])
    for level, (table, n) in enumerate(plan):
        table = table.select(F.col("key").alias("__k"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("l").alias("__l"), F.col("r").alias("__r"), F.lit(True).alias("__hit"))
        same = (F.col(key) == F.col("__k")) & (c["level"] == level) & (c["cx"] == F.col("__cx")) & (c["cy"] == F.col("__cy"))
        joined = out.join(few(table, n), same, "left")
        told = lambda at, l, r, lev: F.struct(lev.alias("level"), at["cx"].alias("cx"), at["cy"].alias("cy"), l.cast("int").alias("l"), r.cast("int").alias("r"))
        below = F.transform(cells(F.col(box), size, level + 1, (c["cx"], c["cy"])), lambda x: told(x, F.lit(0), F.lit(0), F.lit(level + 1)))  # noqa: B023
        own, other = (F.col("__l"), F.col("__r")) if side == "left" else (F.col("__r"), F.col("__l"))
        mine = F.pmod(salt, F.greatest(own, F.lit(1)))
        pick = (lambda k: told(c, mine, k, c["level"])) if side == "left" else (lambda k: told(c, k, mine, c["level"]))
        salted = F.transform(F.sequence(F.lit(0), F.greatest(other, F.lit(1)) - 1), pick)
        options = F.when(F.col("__hit").isNull(), F.array(c)).when(F.col("__l").isNull(), below).otherwise(salted)
        out = joined.withColumn(name, F.explode(options)).select(*columns, name)
    return out


def loads(df: DataFrame, key: str, box: str, size: float, plan: list[tuple[DataFrame, int]], side: str) -> DataFrame:
    """Rows that each cell of the plan gets: what a join's tasks are made of."""
    return dealt(df, key, box, size, plan, side).groupBy(key, "cell").count()
