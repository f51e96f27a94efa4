"""Train, validation and test splits: scores, searches, down-sampling and reset, on a state table instead of moved files."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

SPLITS = ("train", "val", "test")
TARGETS = {"train": 0.70, "val": 0.15, "test": 0.15}
TOLERANCE, PENALTY = 0.10, 1e6


def class_penalty(n: dict[str, Column]) -> Column:
    """Imbalance of one class from its counts by split; 0 for a class without any."""
    whole = n["train"] + n["val"] + n["test"]
    share = lambda s: n[s] / F.when(whole == 0, F.lit(1)).otherwise(whole) - F.lit(TARGETS[s])
    score = sum((share(s) * share(s) * whole for s in SPLITS[1:]), share("train") * share("train") * whole)
    absent = sum((n[s] == 0).cast("int") for s in SPLITS[1:]) * F.lit(PENALTY)
    return F.when(whole == 0, F.lit(0.0)).otherwise(score + absent)


def imbalance(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score of each group of (class_id, split, n) rows."""
    per = counts.groupBy(*keys, "class_id").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in SPLITS])
    return per.withColumn("score", class_penalty({s: F.col(s) for s in SPLITS})).groupBy(*keys).agg(F.sum("score").alias("score"))


def feasible(n: dict[str, Column]) -> Column:
    whole = n["train"] + n["val"] + n["test"]
    near = [F.abs(n[s] / F.when(whole == 0, F.lit(1)).otherwise(whole) - F.lit(TARGETS[s])) <= TOLERANCE for s in SPLITS]
    return (whole > 0) & near[0] & near[1] & near[2]


def exhaustive(per_source: DataFrame) -> DataFrame:
    """All assignments of sources to splits and their scores: (assignment, digits, feasible, score).

    per_source: source_id, n_tiles, counts (map class -> n); at most 15 rows, so 14 million assignments. Digits are those of
    the number in base 3, the first source's the highest. Each assignment is scored in its own row: nothing is shuffled.
    """
    spark = per_source.sparkSession
    n = per_source.count()
    if not 0 < n <= 15:
        raise ValueError("1 to 15 sources")
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.struct(e["key"].alias("c"), e["value"].alias("n")))
    flat = per_source.select("source_id", "n_tiles", entries.alias("counts_list"))
    one = flat.agg(F.sort_array(F.collect_list(F.struct("source_id", "n_tiles", F.to_json("counts_list").alias("j")))).alias("s"))
    one = one.withColumn("s", F.transform("s", lambda x: F.struct(x["source_id"].alias("source_id"), x["n_tiles"].alias("n_tiles"), F.from_json(x["j"], "array<struct<c:int,n:bigint>>").alias("counts_list"))))
    one = one.withColumn("classes", F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.transform(x["counts_list"], lambda e: e["c"]))))))
    every = spark.range(3**n).withColumnRenamed("id", "assignment").crossJoin(F.broadcast(one))
    digits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.floor(F.col("assignment") / F.pow(F.lit(3.0), F.lit(n - 1) - i)), F.lit(3)).cast("int"))
    every = every.withColumn("digits", digits)

    def summed(split: int, value) -> Column:
        both = F.arrays_zip("s", "digits")
        return F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + F.when(x["digits"] == split, value(x["s"])).otherwise(F.lit(0).cast("long")))

    tiles = {s: summed(k, lambda x: x["n_tiles"].cast("long")) for k, s in enumerate(SPLITS)}

    def of_class(c: Column):
        one_class = lambda e: F.when(e["c"] == c, e["n"].cast("long")).otherwise(F.lit(0).cast("long"))
        return lambda x: F.aggregate(x["counts_list"], F.lit(0).cast("long"), lambda a, e: a + one_class(e))

    score = F.aggregate(F.transform("classes", lambda c: class_penalty({s: summed(k, of_class(c)) for k, s in enumerate(SPLITS)})), F.lit(0.0), lambda a, v: a + v)
    all_there = F.size(F.array_distinct("digits")) == 3
    return every.withColumn("feasible", all_there & feasible(tiles)).withColumn("score", F.when(F.col("feasible"), score)).select("assignment", "digits", "feasible", "score")


def best_assignment(scored: DataFrame) -> DataFrame:
    """The lowest score, the first assignment on ties; no row where none is feasible."""
    best = scored.filter("feasible").agg(F.min(F.struct(F.round("score", 6).alias("score"), "assignment", "digits")).alias("best")).filter("best is not null")
    return best.select("best.*")


def hill_climb(tiles: Sequence[int], counts: Sequence[dict[int, int]], spark, restarts: int = 200, seed: int = 42) -> tuple[list[int], float] | None:
    """Best assignment of many sources found by flips from random starts; restarts run as rows of a DataFrame.

    `tiles` and `counts` have an entry a source and go to every task. A flip changes the totals of the classes of its source
    only, so what it costs does not grow with the number of sources.
    """
    n, classes, total = len(tiles), sorted({c for d in counts for c in d}), sum(tiles)

    of_source = [[(j, d[c]) for j, c in enumerate(classes) if d.get(c)] for d in counts]

    def near(held: list[int]) -> bool:
        return all(abs(held[k] / total - TARGETS[name]) <= TOLERANCE for k, name in enumerate(SPLITS))

    def term(by: list[int]) -> float:
        whole = sum(by)
        return sum((by[k] / whole - TARGETS[name]) ** 2 * whole for k, name in enumerate(SPLITS)) + PENALTY * ((by[1] == 0) + (by[2] == 0)) if whole else 0.0

    def climb(frames):
        for frame in frames:
            rows = []
            for k in frame["id"]:
                rng = random.Random(seed * 1_000_003 + int(k))
                a, room = [0] * n, [TARGETS[name] * total for name in SPLITS]
                for i in rng.sample(range(n), n):  # a random order fills the emptiest split: starts lie near the targets
                    a[i] = room.index(max(room))
                    room[a[i]] -= tiles[i]
                held, by = [0] * 3, [[0] * 3 for _ in classes]
                for i, v in enumerate(a):
                    held[v] += tiles[i]
                    for j, c in of_source[i]:
                        by[j][v] += c
                terms = [term(x) for x in by]
                now, better = sum(terms) if near(held) else float("inf"), True

                def move(i: int, v: int) -> list[tuple[int, float]]:
                    """Puts a source into another split; the terms as they were."""
                    u, a[i] = a[i], v
                    held[u] -= tiles[i]
                    held[v] += tiles[i]
                    before = []
                    for j, c in of_source[i]:
                        by[j][u] -= c
                        by[j][v] += c
                        before.append((j, terms[j]))
                        terms[j] = term(by[j])
                    return before

                while better:
                    better = False
                    for i in range(n):
                        for v in range(3):
                            if v == (u := a[i]):
                                continue
                            before = move(i, v)
                            if near(held) and (c := sum(terms)) < now:
                                now, better = c, True
                            else:
                                move(i, u)
                                for j, x in before:
                                    terms[j] = x
                rows.append((int(k), now, a))
            yield pd.DataFrame(rows, columns=["id", "score", "digits"])

    found = spark.range(restarts).repartition(min(restarts, 32)).mapInPandas(climb, "id long, score double, digits array<int>")
    best = found.agg(F.min(F.struct("score", "id", "digits")).alias("b")).first().b
    return (list(best.digits), best.score) if best and best.score < float("inf") else None


def thinned(rows: DataFrame, value: str, keys: Sequence[str] = (), most: int = 100) -> DataFrame:
    """Every k-th distinct value of each group so that about `most` are left, and always the last."""
    distinct = rows.select(*keys, value).distinct()
    w = Window.partitionBy(*keys)
    ranked = distinct.withColumn("rn", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return ranked.filter((F.pmod(F.col("rn"), step) == 0) | (F.col("rn") == F.col("n") - 1)).select(*keys, value)


def assign_by_boundaries(off: Column, size: Column, b1: Column, b2: Column) -> Column:
    """train ends by b1, val starts from b1 and ends by b2, test starts from b2; what straddles is buffer."""
    return F.when(off + size <= b1, "train").when((off >= b1) & (off + size <= b2), "val").when(off >= b2, "test").otherwise("buffer")


def _of_cuts(pairs: DataFrame, cuts: DataFrame, rows: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """(key, group, b1, b2, train, val, test): how many of `rows` (key, group, off, end, n) each pair of cuts puts where.

    train ends by b1, test starts from b2: running sums over offsets tell both for each cut. val is what ends by b2 less what
    starts before b1, and what does both before b1 and after b2 was taken off twice; such rows hold both cuts, so they meet
    only the cuts inside them.
    """
    keys = [key, *group]
    groups = rows.groupBy(*keys).agg(F.sum("n").alias("all"))
    at = cuts.join(groups, key)  # each cut for each group of its source
    running = Window.partitionBy(*keys)

    def upto(place: str, cut_first: bool, name: str) -> DataFrame:
        """Sum of n of rows whose `place` lies before a cut, or at it where rows come first."""
        events = rows.select(*keys, F.col(place).alias("at"), F.lit(0 if not cut_first else 1).alias("turn"), "n", F.lit(None).cast("long").alias("b"))
        marks = at.select(*keys, F.col("b").alias("at"), F.lit(1 if not cut_first else 0).alias("turn"), F.lit(0).cast("long").alias("n"), "b")
        summed = events.unionByName(marks).withColumn(name, F.sum("n").over(running.orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)))
        return summed.filter("b is not null").select(*keys, "b", name)

    sums = upto("end", False, "ended").join(upto("off", True, "begun"), [*keys, "b"]).join(groups, keys)
    one = sums.select(*keys, F.col("b").alias("b1"), F.col("ended").alias("train"), F.col("begun").alias("begun1"))
    two = sums.select(*keys, F.col("b").alias("b2"), F.col("ended").alias("ended2"), (F.col("all") - F.col("begun")).alias("test"))
    held = rows.join(cuts, key).filter("off < b and b < end").groupBy(*keys, "off", "end", "n").agg(F.collect_list("b").alias("bs"))
    held = held.withColumn("b1", F.explode("bs")).withColumn("b2", F.explode("bs")).filter("b2 > b1").groupBy(*keys, "b1", "b2").agg(F.sum("n").alias("twice"))
    met = pairs.join(one, [key, "b1"]).join(two, [*keys, "b2"]).join(held, [*keys, "b1", "b2"], "left")
    return met.select(*keys, "b1", "b2", "train", (F.col("ended2") - F.col("begun1") + F.coalesce("twice", F.lit(0))).alias("val"), "test")


def boundary_search(tiles: DataFrame, labels: DataFrame, key: str = "source_id", off: str = "y_off", size: str = "th") -> DataFrame:
    """Scores of all pairs of row cuts of every source: (key, b1, b2, train, val, test, feasible, score).

    tiles: key, tile_id, off, size; labels: tile_id, class_id. Every offset that a tile has is a cut, so pairs are as many as
    half the square of a source's offsets. Counts are summed by row offset and then along the offsets, so a pair of cuts costs
    the same whatever the number of rows. `thinned` is for callers that want fewer cuts; nothing is thinned here.
    """
    cuts = tiles.select(key, F.col(off).cast("long").alias("b")).dropna(subset=["b"]).distinct()
    pairs = cuts.withColumnRenamed("b", "b1").join(cuts.withColumnRenamed("b", "b2"), key).filter("b2 > b1")
    placed = tiles.select(key, "tile_id", F.col(off).cast("long").alias("off"), (F.col(off) + F.col(size)).cast("long").alias("end"))
    rows = checkpointed(placed.groupBy(key, "off", "end").agg(F.count("*").alias("n")))
    ratio = _of_cuts(pairs, cuts, rows, key).withColumn("feasible", feasible({s: F.col(s) for s in SPLITS}))
    per_row = checkpointed(placed.join(labels, "tile_id").groupBy(key, "class_id", "off", "end").agg(F.count("*").alias("n")))  # a row an offset and class
    # a class that the used tiles of a pair do not hold has total 0 and costs nothing
    scored = _of_cuts(pairs, cuts, per_row, key, ["class_id"]).withColumn("score", class_penalty({s: F.col(s) for s in SPLITS}))
    scored = scored.groupBy(key, "b1", "b2").agg(F.sum("score").alias("score"))
    return ratio.join(scored, [key, "b1", "b2"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_boundaries(scored: DataFrame, tiles: DataFrame, key: str = "source_id", off: str = "y_off") -> DataFrame:
    """(key, b1, b2, score): the best feasible cuts, else cuts by the target shares of row offsets."""
    best = scored.filter("feasible").groupBy(key).agg(F.min(F.struct(F.round("score", 6).alias("score"), "b1", "b2")).alias("best"))
    rows = tiles.select(key, off).distinct().groupBy(key).agg(F.sort_array(F.collect_list(off)).alias("rows"))
    n = F.size("rows")
    cut = lambda share: F.element_at("rows", F.least(F.bround(n * share).cast("int"), n - 1) + 1)
    out = rows.join(best, key, "left")
    return out.select(key, F.coalesce("best.b1", cut(F.lit(TARGETS["train"]))).alias("b1"), F.coalesce("best.b2", cut(F.lit(TARGETS["train"] + TARGETS["val"]))).alias("b2"), F.col("best.score").alias("score"))


def assign(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """tiles with `split`: whole sources from three sources on, else row cuts."""
    n = tiles.select("source_id").distinct().count()
    if n < 3:
        cuts = best_boundaries(boundary_search(tiles, labels), tiles)
        return tiles.join(cuts, "source_id").withColumn("split", assign_by_boundaries(F.col("y_off"), F.col("th"), F.col("b1"), F.col("b2"))).drop("b1", "b2", "score")
    per = source_counts(tiles, labels)
    if n <= 15:
        found = best_assignment(exhaustive(per)).first()
        digits = found.digits if found else None
        ids = [r.source_id for r in per.select("source_id").orderBy("source_id").collect()]
    else:
        rows = per.orderBy("source_id").collect()  # a row a source
        ids = [r.source_id for r in rows]
        climbed = hill_climb([r.n_tiles for r in rows], [r.counts for r in rows], tiles.sparkSession)
        digits = climbed[0] if climbed else None
    if digits is None:
        raise RuntimeError("no assignment within the tolerance")
    state = tiles.sparkSession.createDataFrame([(i, SPLITS[d]) for i, d in zip(ids, digits)], ["source_id", "split"])
    return tiles.join(state, "source_id")


def source_counts(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """source_id, n_tiles, counts (map class -> labels)."""
    counts = tiles.select("tile_id", "source_id").join(labels, "tile_id").groupBy("source_id", "class_id").agg(F.count("*").alias("n"))
    maps = counts.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("class_id", "n"))).alias("counts"))
    out = tiles.groupBy("source_id").agg(F.count("*").alias("n_tiles")).join(maps, "source_id", "left")
    return out.withColumn("counts", F.coalesce("counts", F.create_map().cast("map<int,bigint>")))


def balance(counts: DataFrame) -> DataFrame:
    """(class_id, train, val, test, total, val_share, test_share, balanced) from (class_id, split, n)."""
    per = counts.groupBy("class_id").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in SPLITS])
    per = per.withColumn("total", F.col("train") + F.col("val") + F.col("test")).filter("total > 0")
    per = per.withColumns({"val_share": F.col("val") / F.col("total"), "test_share": F.col("test") / F.col("total")})
    return per.withColumn("balanced", (F.abs(F.col("val_share") - 0.15) < 0.05) & (F.abs(F.col("test_share") - 0.15) < 0.05))


def running_shares(counts: DataFrame) -> DataFrame:
    """(class_id, split, share, upto): percent of each class by split, stacked in the order of splits."""
    order = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    total = F.sum("n").over(Window.partitionBy("class_id"))
    shared = counts.withColumn("share", F.when(total > 0, F.col("n") / total * 100).otherwise(F.lit(0.0)))
    upto = F.sum("share").over(Window.partitionBy("class_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return shared.withColumn("upto", upto)


def downsample_background(tiles: DataFrame, share: float = 0.10, seed: int = 42) -> DataFrame:
    """tiles (tile_id, split, n_labels) with `archived`: background beyond `share` of each split is archived.

    Which stay is told by the md5 of seed and tile, so every engine keeps the same ones. A split without annotated tiles
    stays as it is. The rank is taken in buckets of the hash, so a split's background never sorts in one task.
    """
    background = F.col("n_labels") == 0
    counts = tiles.groupBy("split").agg(F.count_if(~background).alias("annotated"), F.count_if(background).alias("background"))
    keep = F.least(F.floor(F.col("annotated") * F.lit(share / (1.0 - share))), F.col("background"))
    counts = counts.withColumn("keep", F.when(F.col("annotated") == 0, F.col("background")).otherwise(keep))
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("tile_id").cast("string")))
    ordered = tiles.withColumn("order", digest).withColumn("bucket", F.substring("order", 1, 3))
    sizes = ordered.filter(background).groupBy("split", "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("split").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    rank = F.row_number().over(Window.partitionBy("split", "bucket", background).orderBy("order"))
    ranked = ordered.withColumn("rank", rank).join(sizes, ["split", "bucket"], "left").join(F.broadcast(counts.select("split", "keep")), "split")
    return ranked.withColumn("archived", background & (F.coalesce("before", F.lit(0)) + F.col("rank") > F.col("keep"))).drop("order", "bucket", "before", "rank", "keep")


def consolidate(state: DataFrame, key: str = "tile_id") -> DataFrame:
    """All tiles back in train, one of each key: what is in train stays, then val, test, archive."""
    order = F.when(F.col("archived"), 4).otherwise(F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, "split"))
    return state.withColumn("rank", rank).filter("rank = 1").drop("rank").withColumn("came_from", F.when(F.col("archived"), "archive").otherwise(F.col("split"))).withColumns({"split": F.lit("train"), "archived": F.lit(False)})
