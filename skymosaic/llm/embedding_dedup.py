"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Vectors are compared only where their labels are equal. Equal vectors of a label are folded into one with a count first,
so copies cost nothing. Cells come from spherical k-means on at most SAMPLE vectors, as many for a label as it needs to have
about `per_cell` vectors in each (a power of two, MOST_CELLS at most); every vector has a home, the cell of its most similar
centre. If two unit vectors have cosine >= t and homes A and B, they differ by at most w = sqrt(2 - 2 t), so one of them
lies within w / 2 of the plane between A and B: it visits the other's cell. Each vector visits every cell whose plane is
that near, hence no pair is missed, and the search is exact. In a cell its residents meet residents and visitors; visitors
never meet each other there. How many cells a vector visits depends on the vectors: few where they lie in groups, about the
root of the number of cells where they lie at random, so the work grows like n^1.5 at worst until a label has MOST_CELLS cells.

A cell's residents are dealt to blocks of BLOCK, residents and visitors to blocks of WIDE; a task multiplies one of each,
counts links and keeps only the edges of a spanning forest, so what is emitted grows with the vectors, not with their pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do null labels;
components of any finite size count; vectors of different lengths link with nothing; ties go to the smallest id; null ids
come last: a group of null ids only has component null, and each of its rows is kept; an id that repeats makes rows of its
own (its count is of other rows); an empty table gives an empty table; other columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, stored
from .components import connected_components, tie

#: Vectors that the cells are fitted on, cells of a label, vectors that a cell should hold; vectors of a block on either side.
SAMPLE, MOST_CELLS, PER_CELL, BLOCK, WIDE = 16_384, 4_096, 4_096, 2_048, 8_192
LAST = (1 << 63) - 1


def fit_cells(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means; starts from evenly spaced rows, an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 1e-9] = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return centres


def homes_and_visits(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and a matrix of the cells that it visits (its home among them)."""
    near = x @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    visits = near[np.arange(len(x)), home][:, None] - near <= reach * apart[home] + 1e-9
    visits[np.arange(len(x)), home] = True
    return home, visits


def _normalised(vectors: pa.Array) -> np.ndarray:
    """Unit vectors; divided by their largest components first, so that no square leaves the range of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


_NODE = "struct<rep:bigint,tag:bigint>"


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, per_cell: int = PER_CELL) -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable), kept (it is that id)."""
    spark = vectors.sparkSession
    ship(spark)
    all_rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    value = lambda x: F.coalesce(x, F.lit(float("nan")))
    finite = lambda x: ~F.isnan(value(x)) & (F.abs(value(x)) < F.lit(float("inf")))
    sound = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", finite), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = all_rows.filter(sound)
    folded = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    folded = stored(folded.select(F.struct("rep", F.xxhash64("label", "v").alias("tag")).alias("node"), "label", "v", "n", F.size("v").alias("d")), "vectors")
    # cells of each label and length: a power of two
    cells = F.least(F.lit(MOST_CELLS), F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.round(F.log2(F.count("*") / F.lit(float(per_cell)))))))
    wanted = stored(folded.groupBy("label", "d").agg(cells.cast("int").alias("k")), "cells")
    counts, edges = [], []
    for d, ks in wanted.groupBy("d").agg(F.sort_array(F.collect_set("k"))).orderBy("d").collect():  # a row a length
        links = stored(_links(folded.filter(F.col("d") == d), wanted.filter(F.col("d") == d).drop("d"), ks, threshold), f"links-{d}")
        counts.append(links.filter("other is null"))
        edges.append(links.filter("other is not null"))
    rest = all_rows.filter(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if counts:
        all_counts, all_edges = counts[0], edges[0]
        for c, e in zip(counts[1:], edges[1:]):
            all_counts, all_edges = all_counts.unionByName(c), all_edges.unionByName(e)
        total = all_counts.groupBy("node").agg(F.sum("links").alias("links"))
        groups = connected_components(all_edges, "node", "other").withColumnRenamed("component", "least")
        members = folded.join(total, "node", "left").join(groups, "node", "left")
        members = members.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least.rep", "node.rep").alias("component"))
        rest = good.join(members, ["label", "v"]).select("id", "n_links", "component").unionByName(rest)
    return rest.select(F.nullif("id", F.lit(LAST)).alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.nullif("component", F.lit(LAST)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _links(folded: DataFrame, wanted: DataFrame, ks: list[int], threshold: float) -> DataFrame:
    """(node, other, links): link counts (other null) and forest edges (links null) among vectors of one length; `wanted`: cells of each label."""
    spark = folded.sparkSession
    sample = _normalised(folded.select("v").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow().column("v").combine_chunks())
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) / 2
    shared = spark.sparkContext.broadcast({k: fit_cells(sample, k) for k in ks})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("k").to_numpy()
            for k in np.unique(kinds).tolist():
                some = batch.filter(pa.array(kinds == k))
                for i in range(0, some.num_rows, 2_000):
                    part = some.slice(i, 2_000)
                    home, visits = homes_and_visits(_normalised(part.column("v")), shared.value[k], reach)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(visits.sum(1))), pa.int32()), pa.array(np.nonzero(visits)[1], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "v", "node", "n")), pa.array(home, pa.int32()), lists], ["label", "v", "node", "n", "home", "cells"])

    placed = folded.join(wanted, "label").select("label", "v", "node", "n", "k").mapInArrow(assign, f"label string, v array<double>, node {_NODE}, n long, home int, cells array<int>")
    placed = stored(placed, "placed")
    seen = placed.select("label", "home", F.explode("cells").alias("cell"))
    resident = (F.col("home") == F.col("cell")).cast("int")
    in_cell = seen.groupBy("label", "cell").agg(F.ceil(F.sum(resident) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / WIDE).cast("int").alias("wide")).filter("blocks > 0")
    rows = placed.select("*", F.explode("cells").alias("cell")).join(in_cell, ["label", "cell"])
    of = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    keys = ["label", "cell", "i", "j"]
    none = F.lit(None).cast("array<int>")
    left = rows.filter("home = cell").withColumn("i", of(1, "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).select(*keys, F.lit(True).alias("left"), "node", "n", "home", "cells", "v")
    right = rows.withColumn("j", of(2, "wide")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, F.lit(False).alias("left"), "node", "n", "home", none.alias("cells"), "v")

    def products(key, data):
        cell = key[1].as_py()
        is_left = data.column("left").to_numpy(zero_copy_only=False)
        node = data.column("node").combine_chunks()
        rep, tag = (node.field(c).to_numpy() for c in (0, 1))
        copies, home = data.column("n").to_numpy(), data.column("home").to_numpy()
        x = _normalised(data.column("v").combine_chunks())
        lists = data.column("cells").combine_chunks()
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        visits = np.zeros((len(left), MOST_CELLS), bool)
        visits[np.repeat(np.arange(len(left)), np.diff(lists.offsets.to_numpy())[left]), lists.flatten().to_numpy()] = True
        # a node may stand on both sides: it is numbered by its order
        order = np.lexsort((tag, rep))
        fresh = np.append(True, (rep[order][1:] != rep[order][:-1]) | (tag[order][1:] != tag[order][:-1]))
        place = np.empty(len(rep), np.int64)
        place[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        links = np.zeros(len(first), np.int64)
        label = np.arange(len(first))
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            p, q = np.nonzero(x[rows] @ x[right].T >= threshold)
            p += a
            l, r = left[p], right[q]  # noqa: E741
            # residents meet in both orders; a visitor meets a resident also at home, if that one visits there
            ok = np.where(home[r] == cell, place[l] < place[r], ~visits[p, home[r]] | (cell < home[r]))
            l, r = l[ok], r[ok]  # noqa: E741
            np.add.at(links, place[l], copies[r])
            np.add.at(links, place[r], copies[l])
            label = tie(label, place[l], place[r])
        tied = [(s, int(label[s])) for s in np.flatnonzero(label != np.arange(len(label))).tolist()]
        some = np.flatnonzero(links)
        name = lambda k: {"rep": int(rep[first[k]]), "tag": int(tag[first[k]])}
        kind = pa.struct([("rep", pa.int64()), ("tag", pa.int64())])
        return pa.table({
            "node": pa.array([name(k) for k in some] + [name(s) for s, _ in tied], kind), "other": pa.array([None] * len(some) + [name(r) for _, r in tied], kind),
            "links": pa.array([*links[some].tolist(), *[None] * len(tied)], pa.int64()),
        })

    return left.unionByName(right).repartition(max(1, partitions(spark)), *keys).groupBy(*keys).applyInArrow(products, f"node {_NODE}, other {_NODE}, links long")
