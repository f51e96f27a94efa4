"""Layout of vectors in two dimensions by stochastic neighbour embedding, every row taking part.

1. Vectors go to the cells of a coarse k-means; each looks for its nearest neighbours in the few cells nearest to it, residents
   and visitors of a cell meeting block by block. Gaussian weights of the wanted perplexity make a sparse graph, both ways.
2. Rows of one cell make a block, so most of a row's neighbours are in its own block; a row's number tells its block and its place
   in it. A block's edges are gathered once and written as one row. Rounds run on written coordinates and shuffle nothing but
   masses: a task reads TOGETHER blocks with their edges, streams the written coordinates by, keeps those that its edges lead to,
   and has a grid of the whole layout's mass. Edges attract; the grid repels, fine cells nearby and coarse ones beyond. Within a
   round a block makes several steps, during which all other blocks and the grid stand still.

What comes to the driver is a sample of SAMPLE vectors, the sizes of the cells and, in each round, the bounds and the GRID x GRID
masses of the layout. No task works on more than TOGETHER blocks of about BLOCK rows with their edges. Rows with a null vector are left out; ids are unique;
equal vectors lie together; one row lies in the middle; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .cluster import written

#: Vectors that cells are fitted on, rows of a cell that are aimed at, cells at most, and rows of a block.
SAMPLE, PER_CELL, MOST_CELLS, BLOCK = 16_384, 1_024, 1_024, 2_048
#: Blocks that a task moves at once, and numbers that a block has for its rows.
TOGETHER, ROOM = 8, 1 << 24
#: Cells that a vector looks for its neighbours in.
PROBES = 4
#: Cells of the layout's grid along each side, and fine ones in a coarse one.
GRID, COARSE = 64, 4
#: Share of the rounds with stronger attraction, and how much stronger.
EARLY, STRONGER = 0.2, 12.0


def _written(df: DataFrame, name: str) -> DataFrame:
    return _kept(df, name)[0]


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The written table and its folder."""
    spark = df.sparkSession
    path = scratch(spark, f"layout-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        home = _apart(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(home, minlength=k)
        np.add.at(sums, home, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def weights(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of squared distances (missing ones infinite) to weights that sum to 1 and have the wanted entropy, as far as neighbours allow."""
    d = d - d.min(1, keepdims=True)
    have = np.isfinite(d)
    goal = np.log(np.minimum(perplexity, np.maximum(1.1, have.sum(1) / 3)))
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    far = np.where(have, d, 0.0)
    for _ in range(60):
        e = np.where(have, np.exp(-far * beta[:, None]), 0.0)
        total = e.sum(1)
        entropy = np.log(total) + beta * (e * far).sum(1) / total
        up = entropy > goal
        low, high = np.where(up, beta, low), np.where(up, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return e / total[:, None]


def settled(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """(i, block, id, v, cells) of every node (i, id, v): the PROBES cells nearest to it, its own first, and a new number, which is
    ROOM times its block plus its place in the block."""
    probes = min(PROBES, len(centres))

    def assign(frames):
        for frame in frames:
            x = np.stack(frame.v.to_numpy()) if len(frame) else np.zeros((0, centres.shape[1]))
            for b in range(0, len(frame), 4_096):
                part = frame.iloc[b : b + 4_096]
                near = np.argsort(_apart(x[b : b + 4_096], centres), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pd.DataFrame({"i": part.i, "id": part.id, "v": part.v, "cells": list(near)})

    placed = nodes.select("i", "id", "v").mapInPandas(assign, f"i long, id {nodes.schema['id'].dataType.simpleString()}, v array<double>, cells array<int>").withColumn("home", F.get("cells", F.lit(0)))
    sizes = placed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("m"))
    sizes = nodes.sparkSession.createDataFrame(_firsts(sizes.orderBy("home").collect()), "home int, m long, first long")  # a row a cell
    block = F.col("first") + F.pmod(F.xxhash64("i"), F.col("m"))
    numbered = placed.join(F.broadcast(sizes), "home").withColumn("block", block).withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("i")))
    return _written(numbered.select((F.col("block") * ROOM + F.col("k") - 1).alias("i"), "block", "id", "v", "cells"), "placed")


def _firsts(sizes: list) -> list[tuple[int, int, int]]:
    """Blocks are numbered through all cells."""
    ends = np.cumsum([r.m for r in sizes]).tolist()
    return [(r.home, r.m, end - r.m) for r, end in zip(sizes, ends)]


def neighbours(placed: DataFrame, k: int, perplexity: float) -> DataFrame:
    """(i, j, p): weights of every settled row's k nearest, found in its cells."""
    seen = placed.select(F.get("cells", F.lit(0)).alias("home"), F.explode("cells").alias("cell"))
    sizes = seen.groupBy("cell").agg(F.ceil(F.count_if(F.col("home") == F.col("cell")) / BLOCK).alias("blocks"), F.ceil(F.count("*") / BLOCK).alias("wide")).filter("blocks > 0")
    rows = placed.select("i", "v", F.get("cells", F.lit(0)).alias("home"), F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
    of = lambda salt, n: F.pmod(F.xxhash64("i", F.lit(salt)), F.col(n))
    one_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    residents = rows.filter("home = cell").withColumn("a", of(1, "blocks")).withColumn("b", one_to("wide")).select("cell", "a", "b", F.lit(True).alias("resident"), "i", "v")
    visitors = rows.withColumn("b", of(2, "wide")).withColumn("a", one_to("blocks")).select("cell", "a", "b", F.lit(False).alias("resident"), "i", "v")

    def nearest(frame: pd.DataFrame) -> pd.DataFrame:
        here, come = frame[frame.resident], frame[~frame.resident]
        out = {"i": come.i.to_numpy(), "j": [], "d": []}
        if not len(here) or not len(come):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        y, ids = np.stack(here.v.to_numpy()), here.i.to_numpy()
        for b in range(0, len(come), 512):
            part = come.iloc[b : b + 512]
            d = _apart(np.stack(part.v.to_numpy()), y)
            d[part.i.to_numpy()[:, None] == ids[None, :]] = np.inf
            m = min(k, len(ids))
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            out["j"] += list(ids[near])
            out["d"] += list(np.take_along_axis(d, near, 1))
        return pd.DataFrame(out)

    found = residents.unionByName(visitors).groupBy("cell", "a", "b").applyInPandas(nearest, "i long, j array<long>, d array<double>")
    gathered = found.groupBy("i").agg(F.flatten(F.collect_list("j")).alias("j"), F.flatten(F.collect_list("d")).alias("d"))

    def weigh(frames):
        for frame in frames:
            best = []
            for j, d in zip(frame.j, frame.d):
                order = np.lexsort((j, d))[:k]
                order = order[np.isfinite(d[order])]
                best.append((j[order], d[order]))
            wide = max((len(j) for j, _ in best), default=0)
            if not wide:
                continue
            d = np.full((len(best), wide), np.inf)
            for r, (_, x) in enumerate(best):
                d[r, : len(x)] = x
            some = np.isfinite(d).any(1)
            p = np.zeros_like(d)
            p[some] = weights(d[some], perplexity)
            yield pd.DataFrame({"i": np.repeat(frame.i.to_numpy(), [len(j) for j, _ in best]), "j": np.concatenate([j for j, _ in best]), "p": np.concatenate([p[r, : len(j)] for r, (j, _) in enumerate(best)])})

    return gathered.mapInPandas(weigh, "i long, j long, p double")


def gathered_edges(placed: DataFrame, single: DataFrame) -> DataFrame:
    """(block, degree, slot, p, needs), a row a block: the edges both ways of its rows in order, equal ones added up. A slot below the
    block's size is a row of its own, one above is a row of `needs`, the ascending numbers of rows in other blocks."""
    ways = F.explode(F.array(F.struct("i", "j", "p"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "p"))).alias("e")
    every = placed.select("i", F.col("i").alias("j"), F.lit(0.0).alias("p"))  # rows without edges, too
    both = single.select(ways).select("e.*").unionByName(every).withColumn("block", F.floor(F.col("i") / ROOM))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame.block.iloc[0])
        i, j, p = frame.i.to_numpy() - block * ROOM, frame.j.to_numpy(), frame.p.to_numpy()
        m = int(i.max()) + 1
        real = j != frame.i.to_numpy()
        i, j, p = i[real], j[real], p[real]
        order = np.lexsort((p, j, i))
        i, j, p = i[order], j[order], p[order]
        new = np.flatnonzero(np.append(np.ones(min(1, len(i)), bool), (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        i, j, p = i[new], j[new], np.add.reduceat(p, new) if len(new) else p
        away = j // ROOM != block
        needs = np.unique(j[away])
        slot = np.where(away, m + np.searchsorted(needs, j), j - block * ROOM)
        return pd.DataFrame({"block": [block], "degree": [np.bincount(i, minlength=m)], "slot": [slot], "p": [p], "needs": [needs]})

    return both.groupBy("block").applyInPandas(gather, "block long, degree array<int>, slot array<int>, p array<double>, needs array<long>")


class Mass:
    """The grid of a layout's mass and the field that it makes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: list[tuple[int, int, float, float, float]]):
        self.low, self.step = low, np.maximum(high - low, 1e-12) / GRID
        self.fine = np.zeros((3, GRID + 2 * COARSE, GRID + 2 * COARSE))  # count and sums of both coordinates; a rim of empty cells
        for cx, cy, n, sx, sy in cells:
            self.fine[:, cx + COARSE, cy + COARSE] += n, sx, sy
        side = GRID // COARSE + 2
        self.coarse = self.fine.reshape(3, side, COARSE, side, COARSE).sum((2, 4)).reshape(3, -1)
        self.side = side

    def place(self, y: np.ndarray) -> np.ndarray:
        return np.clip(((y - self.low) / self.step).astype(int), 0, GRID - 1)

    def field(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the kernel, sum of the squared kernel times the way from the mass) at each place, which is part of the mass itself."""
        at = self.place(y)
        big = at // COARSE
        total, push = np.zeros(len(y)), np.zeros((len(y), 2))

        def add(n, cx, cy):
            dx, dy = y[:, 0, None] - cx, y[:, 1, None] - cy
            q = 1 / (1 + dx * dx + dy * dy)
            total[:] += (n * q).sum(1)
            q *= q * n
            push[:, 0] += (q * dx).sum(1)
            push[:, 1] += (q * dy).sum(1)

        full = np.flatnonzero(self.coarse[0])
        n, sx, sy = self.coarse[:, full]
        near = np.maximum(np.abs(full // self.side - 1 - big[:, 0, None]), np.abs(full % self.side - 1 - big[:, 1, None])) <= 1
        add(np.where(near, 0.0, n), sx / n, sy / n)
        span = np.arange(3 * COARSE)
        rows, cols = (big[:, 0, None] * COARSE + span)[:, :, None], (big[:, 1, None] * COARSE + span)[:, None, :]
        n, sx, sy = (m[rows, cols].reshape(len(y), -1) for m in self.fine)
        own = (at[:, 0] % COARSE + COARSE) * 3 * COARSE + at[:, 1] % COARSE + COARSE
        k = np.arange(len(y))
        n, sx, sy = n.copy(), sx.copy(), sy.copy()
        held = np.minimum(n[k, own], 1.0)
        n[k, own] -= held
        sx[k, own] -= held * y[:, 0]
        sy[k, own] -= held * y[:, 1]
        some = np.maximum(n, 1e-9)
        add(np.where(n > 0.5, n, 0.0), np.where(n > 0.5, sx / some, 0.0), np.where(n > 0.5, sy / some, 0.0))
        return total, push


#: Blocks and the places and speeds of their rows in order; z is the sum of the kernel over the block.
STATE = "block long, x array<double>, y array<double>, u array<double>, w array<double>, z double"


def mover(folder: str, mass: Mass, pull: float, momentum: float, rate: float, whole: float, steps: int):
    """What tasks do in a round with blocks and their edges: `steps` steps among standing neighbours of other blocks, whose places are
    in the folder, and a standing grid."""

    def list_at(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
        return batch.column(name)[k].values.to_numpy(zero_copy_only=False)

    def move(y: np.ndarray, speed: np.ndarray, degree: np.ndarray, j: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        m = len(degree)
        i, p = np.repeat(np.arange(m), degree), p * pull
        for _ in range(steps):
            d = y[i] - y[j]
            f = (p / (1 + (d**2).sum(1)))[:, None] * d
            attract = np.stack([np.bincount(i, f[:, a], m) for a in (0, 1)], 1)
            total, push = np.empty(m), np.empty((m, 2))
            for b in range(0, m, 256):
                total[b : b + 256], push[b : b + 256] = mass.field(y[b : min(b + 256, m)])
            speed = momentum * speed - rate * 4 * (attract - push / whole)
            size = np.sqrt((speed**2).sum(1, keepdims=True))
            speed *= np.minimum(1.0, 5.0 / np.maximum(size, 1e-12))
            y[:m] += speed
        return y[:m], speed, float(total.sum())

    def moved(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begin, TOGETHER)
                blocks = part.column("block").to_pylist()
                needs = [list_at(part, "needs", k) for k in range(len(blocks))]
                sizes = [len(part.column("degree")[k]) for k in range(len(blocks))]
                places = [np.empty((m + len(x), 2)) for m, x in zip(sizes, needs)]
                speeds = [np.empty((m, 2)) for m in sizes]
                for others in written(folder, TOGETHER):
                    for o, other in enumerate(others.column("block").to_pylist()):
                        ends = [np.searchsorted(x, (other * ROOM, (other + 1) * ROOM)) for x in needs]
                        if other not in blocks and not any(b > a for a, b in ends):
                            continue
                        xy = np.stack([list_at(others, "x", o), list_at(others, "y", o)], 1)
                        for k, (a, b) in enumerate(ends):
                            places[k][sizes[k] + a : sizes[k] + b] = xy[needs[k][a:b] - other * ROOM]
                            if blocks[k] == other:
                                places[k][: sizes[k]] = xy
                                speeds[k][:] = np.stack([list_at(others, "u", o), list_at(others, "w", o)], 1)
                for k, block in enumerate(blocks):
                    y, speed, z = move(places[k], speeds[k], *(list_at(part, c, k) for c in ("degree", "slot", "p")))
                    told = {"block": [block], "x": [y[:, 0]], "y": [y[:, 1]], "u": [speed[:, 0]], "w": [speed[:, 1]], "z": [z]}
                    yield pa.RecordBatch.from_pydict(told)

    return moved


def embed_2d(df: DataFrame, id_col: str, vector: str, perplexity: float = 30.0, steps: int = 300, rounds: int = 60, seed: int = 42) -> DataFrame:
    """(id, tsne_1, tsne_2) of every row with a vector; `steps` in `rounds`."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    nodes = _written(df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null").withColumn("i", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("id").alias(id_col), F.lit(0.0).alias("tsne_1"), F.lit(0.0).alias("tsne_2"))
    sample = np.stack([r.v for r in nodes.select("v").orderBy(F.xxhash64("i"), "i").limit(SAMPLE).collect()])
    centres = _centres(sample, min(MOST_CELLS, max(1, round(n / PER_CELL)), len(sample)))
    k = min(n - 1, max(1, int(3 * perplexity)))
    placed = settled(nodes, centres)
    single = neighbours(placed, k, perplexity).select("i", "j", (F.col("p") / (2 * n)).alias("p"))
    graph = _written(gathered_edges(placed, single), "graph")

    # start: the two widest directions of the sample, small, with a little of a hash so that equal rows part
    middle = sample.mean(0)
    axes = np.linalg.svd(sample - middle, full_matrices=False)[2][:2]
    axes = np.vstack([axes, np.zeros((2 - len(axes), sample.shape[1]))])
    scale = 1e-2 / max(float(np.abs((sample - middle) @ axes.T).std()), 1e-12)

    def start(frames):
        for frame in frames:
            x = np.stack(frame.v.to_numpy()) if len(frame) else np.zeros((0, len(middle)))
            y = (x - middle) @ axes.T * scale
            yield pd.DataFrame({"block": frame.block, "i": frame.i, "x": y[:, 0] + frame.a * 1e-4, "y": y[:, 1] + frame.b * 1e-4})

    noise = lambda s: ((F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(2_000_001)) - 1_000_000) / 1e6)
    spots = placed.select("block", "i", "v", noise(0).alias("a"), noise(1).alias("b")).mapInPandas(start, "block long, i long, x double, y double")
    rows = spots.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    still = F.transform("r", lambda r: F.lit(0.0))
    state, folder = _kept(rows.select("block", F.col("r.x").alias("x"), F.col("r.y").alias("y"), still.alias("u"), still.alias("w"), (F.size("r") * float(n - 1)).alias("z")), "state")
    inner = max(1, steps // rounds)
    for round_ in range(rounds):
        b = state.agg(F.min(F.array_min("x")), F.max(F.array_max("x")), F.min(F.array_min("y")), F.max(F.array_max("y")), F.sum("z")).first()
        low, high, whole = np.array([b[0], b[2]]), np.array([b[1], b[3]]), max(float(b[4]), 1e-12)
        width = np.maximum(high - low, 1e-12) / GRID
        cell = lambda c, a: F.least(F.floor((F.col(c) - F.lit(float(low[a]))) / F.lit(float(width[a]))), F.lit(GRID - 1))  # noqa: B023,E731
        spread = state.select(F.explode(F.arrays_zip("x", "y")).alias("r")).select("r.x", "r.y")
        mass = Mass(low, high, [tuple(r) for r in spread.groupBy(cell("x", 0).alias("cx"), cell("y", 1).alias("cy")).agg(F.count("*"), F.sum("x"), F.sum("y")).collect()])
        early = round_ < EARLY * rounds
        pull, momentum, rate = STRONGER if early else 1.0, 0.5 if early else 0.8, max(n / STRONGER / 4, 200.0)
        state, folder = _kept(graph.mapInArrow(mover(folder, mass, pull, momentum, rate, whole, inner), STATE), f"round-{round_}")
    found = state.select("block", F.posexplode(F.arrays_zip("x", "y")).alias("k", "r")).select((F.col("block") * ROOM + F.col("k")).alias("i"), "r.x", "r.y")
    return placed.select("i", "id").join(found, "i").select(F.col("id").cast(kind).alias(id_col), F.col("x").alias("tsne_1"), F.col("y").alias("tsne_2"))
