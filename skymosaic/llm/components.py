"""Connected components by least labels and path halving on written edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: More rounds than any graph of 2^60 nodes needs when paths halve; a guard against endless runs.
ROUNDS = 60


def tie(label: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """`label` (each row's least known member, which is its own label) once the rows s[k] and t[k] are linked for every k.

    All pairs are taken at once: groups that a pair joins take the lesser label, then every row its label's label; pairs
    whose sides agree are done. Rounds are few, as groups at least halve in number.
    """
    while len(s):
        a, b = label[s], label[t]
        apart = a != b
        if not apart.any():
            break
        s, t, a, b = s[apart], t[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, np.maximum(a, b), low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def thinned(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (a, b) with the same components, about one for each node of `a`: a node keeps its edge to the least node of `b`
    that it names, and the others that it names are tied to that one, which is once for all nodes that name the same."""
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).withColumn("root", F.min("b").over(Window.partitionBy("a")))
    tied = named.select(F.explode(F.array("a", "b")).alias("node"), "root").filter("node <> root").distinct()
    return tied.select(F.col("node").alias(a), F.col("root").alias(b))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of `edges`; nodes without edges are not listed.

    Nodes may be of any type that has an order. Each round points every node to the least label among itself and its
    neighbours, then to that label's own label (halving paths), until nothing changes. Least labels are aggregated before
    the shuffle, so a node with very many edges costs no task more than its share; edges and labels live in written tables.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(e.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("label")), "labels")
    for _ in range(ROUNDS):
        near = e.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label's own label: also what the round has found for the old label reaches its whole group; only labels
        # that change are rows of the right sides, which so are small and broadcast once groups have found their least nodes
        roots = hooked.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("group_label")).filter("group_label < root")
        hooked = hooked.join(roots, hooked.old == roots.root, "left").select("u", "old", F.least("label", "group_label").alias("label"))
        jump = hooked.select(F.col("u").alias("label"), F.col("label").alias("further")).filter("further < label")
        after = stored(hooked.join(jump, "label", "left").select("u", F.coalesce("further", "label").alias("label"), "old"), "labels")
        labels = after.select("u", "label")
        if not after.filter("label <> old").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
