"""Merkle manifest of a table: a digest of every row, a tree over the rows of each group, a root over the groups, and proofs.

A leaf is the SHA-256 of a row's fields, each as its byte count, a colon and its text (`-` for a null). In a tree every run of
`arity` neighbours becomes the SHA-256 of their digests' hex texts, level by level, until one node remains; the last run of a
level may be shorter, and as a tree's number of leaves is known, so is the number of nodes in each of its runs.

The trees are built as a sparse forest. A fragment is a set of unresolved nodes, keyed by tree, level and index. `climb`
makes the fragment of a range of neighbouring leaves: runs that lie in it whole are resolved, at most 2 * (arity - 1) nodes a
level are left at its two ends. `merge` joins fragments and resolves every run that this completes; it is associative and
commutative, so fragments are reduced in a tree: `reduce_forest` merges `fan` neighbouring ones in each round, until one is
left, in rounds that Spark runs as grouped tasks over written tables. (`RDD.treeReduce` is not used: it merges fragments that
are not neighbours, hence resolves little before the driver.) No task sees more than a range of leaves or `fan` fragments, and
nothing but a count of ranges comes to the driver.

Cases: a null group is a group of its own and comes first; leaves of a group ascend by id, null ids first, rows of one id by
their digest, equal rows as they are stored; a null or empty text has a digest like any other, and texts of any length are
read whole; an empty table gives an empty table; a row's other columns do not count unless they are named in `fields`. Only
rows whose id is not null are tampered with.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, ship, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The key of the tree over the groups; groups' own keys are empty or begin with "=".
TOP = "^"
#: Leaves of a range: what one task holds.
RANGE = 200_000
FAN = 32
_NODES = "part int, tree string, total long, level int, index long, digest string, made boolean, state string"


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """Hex SHA-256 of columns, each as byte count, colon and text, or `-`."""

    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[told(c) for c in fields]).cast("binary"), 256)


def leaves(docs: DataFrame, id_col: str, group_col: str, fields: tuple[str, ...], text_col: str, tampered: Column) -> DataFrame:
    """id, `tree` (the group's key), `leaf`, and `forged`: the leaf of a row whose text has its A-Z in lower case where `tampered`."""
    forged = [F.translate(F.col(f), _UPPER, _LOWER) if f == text_col else F.col(f) for f in fields]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    own = leaf([F.col(f) for f in fields])
    return docs.select(F.col(id_col).alias("id"), tree.alias("tree"), own.alias("leaf"), F.when(tampered, leaf(forged)).alias("forged"))


def climb(first: int, digests: list[str], total: int, arity: int) -> list[tuple[int, int, str, str]]:
    """(level, index, digest, state) of the nodes over leaves `first`, `first`+1, ... of a tree of `total`.

    A node is `closed` if its run lies in the range whole, `root` if it is the tree's, and else `open`.
    """
    out, level = [], 0
    while digests and total > 1:
        low, after = -(-first // arity), first + len(digests)
        high = max(low, -(-total // arity) if after == total else after // arity)
        begin, end = min(low * arity, after), max(first, min(high * arity, after))
        out += [(level, first + k, d, "closed" if begin <= first + k < end else "open") for k, d in enumerate(digests)]
        whole = digests[begin - first : end - first]
        digests = [digest_of(whole[k : k + arity]) for k in range(0, len(whole), arity)]
        first, total, level = low, -(-total // arity), level + 1
    return out + [(level, 0, d, "root") for d in digests]


def merge(nodes: list[dict], arity: int) -> list[dict]:
    """Fragments joined: every run that is complete becomes a node, and so on upwards.

    A node's `state` is `open`, `closed` once its run is complete, or `root`; `made` tells those that came about here.
    """
    trees: dict[str, dict[int, dict[int, dict]]] = defaultdict(lambda: defaultdict(dict))
    for x in nodes:
        trees[x["tree"]][x["level"]][x["index"]] = x | {"made": False}
    out = []
    for tree, levels in trees.items():
        leaf_total = next(iter(next(iter(levels.values())).values()))["total"]
        level, total = 0, leaf_total
        while level <= max(levels):
            here = levels.get(level, {})
            runs: dict[int, list[int]] = defaultdict(list)
            for i in sorted(here):
                runs[i // arity].append(i)
            for run, members in runs.items():
                complete = total > 1 and len(members) == min(arity, total - run * arity)
                for i in members:
                    out.append(here[i] | {"state": "root" if total == 1 else "closed" if complete else "open"})
                if complete:
                    levels[level + 1][run] = {"tree": tree, "total": leaf_total, "level": level + 1, "index": run, "digest": digest_of(here[i]["digest"] for i in members), "made": True}
            level, total = level + 1, -(-total // arity)
    return out


def _table(rows: list[dict], part: int) -> pa.Table:
    kinds = {"part": pa.int32(), "tree": pa.string(), "total": pa.int64(), "level": pa.int32(), "index": pa.int64(), "digest": pa.string(), "made": pa.bool_(), "state": pa.string()}
    return pa.table({c: pa.array([part if c == "part" else x[c] for x in rows], kind) for c, kind in kinds.items()})


def _slices(leaves: pa.Table) -> Iterable[pa.Table]:
    """The leaves of one range tree by tree, in the order of their places."""
    leaves = leaves.take(pc.sort_indices(leaves, sort_keys=[("tree", "ascending"), ("place", "ascending")])).combine_chunks()
    ends = [*pc.run_end_encode(leaves["tree"].combine_chunks()).run_ends.to_pylist()] if len(leaves) else []
    for begin, end in zip([0, *ends], ends):
        yield leaves.slice(begin, end - begin)


def reduce_forest(placed: DataFrame, arity: int, name: str, fan: int = FAN, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of trees whose leaves are `placed` (tree, leaf, part, place, total).

    The nodes are those that a range could not resolve alone, and those made from them; with `every`, all.
    """

    def fragment(leaves: pa.Table) -> pa.Table:
        rows = []
        for own in _slices(leaves):
            tree, total = own["tree"][0].as_py(), own["total"][0].as_py()
            found = climb(own["place"][0].as_py(), own["leaf"].to_pylist(), total, arity)
            rows += [{"tree": tree, "total": total, "level": level, "index": i, "digest": d, "made": True, "state": state} for level, i, d, state in found if every or state != "closed"]
        return _table(rows, leaves["part"][0].as_py())

    def join(fragments: pa.Table) -> pa.Table:
        return _table(merge(fragments.to_pylist(), arity), fragments["part"][0].as_py())

    round_ = stored(placed.select("part", "tree", "total", "place", "leaf").groupBy("part").applyInArrow(fragment, _NODES), f"{name}-fragments")
    nodes, parts = round_, (placed.agg(F.max("part")).first()[0] or 0) + 1
    roots = round_.filter("state = 'root'")
    while parts > 1:
        near = round_.filter("state = 'open'").withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        round_ = stored(near.groupBy("part").applyInArrow(join, _NODES), f"{name}-merged")
        nodes, roots = nodes.unionAll(round_.filter("made")), roots.unionAll(round_.filter("state = 'root'"))
        parts = -(-parts // fan)
    return nodes.select("tree", "level", "index", "digest"), roots.select("tree", F.col("digest").alias("leaf"))


def _runs(low: Column, high: Column, total: Column, arity: int) -> Column:
    """array<struct<level, run>>: at every level the first and the last run that leaves `low` to `high` of a tree lie under."""
    most = 1
    while arity ** (most + 1) < 1 << 62:
        most += 1
    ends = [F.struct(F.lit(k).alias("level"), F.floor(x / F.lit(arity ** (k + 1))).alias("run")) for k in range(most) for x in (low, high)]
    return F.array_distinct(F.filter(F.array(*ends), lambda e: total > F.pow(F.lit(float(arity)), e["level"])))


def paths(first: int, digests: list[str], total: int, outer: dict[tuple[int, int], str], arity: int) -> tuple[list[tuple[int, list[list[str]]]], str]:
    """For each level (index of the first node, whole runs that the leaves lie under), and the root; `outer` has what other ranges hold."""
    levels, level = [], 0
    while total > 1:
        after = first + len(digests)
        begin, end = first // arity * arity, min(((after - 1) // arity + 1) * arity, total)
        whole = [*(outer[level, i] for i in range(begin, first)), *digests, *(outer[level, i] for i in range(after, end))]
        runs = [whole[k : k + arity] for k in range(0, len(whole), arity)]
        levels.append((begin, runs))
        digests = [digest_of(r) for r in runs]
        first, total, level = begin // arity, -(-total // arity), level + 1
    return levels, digests[0]


def _siblings(levels: list[tuple[int, list[list[str]]]], above: str, arity: int) -> list[str]:
    """Of each node of the lowest level: its siblings, then those of its parent, and so on, then `above`."""
    texts, base = [above], 0
    for begin, runs in reversed(levels):
        skip = begin // arity - base
        texts = ["".join(run[:k]) + "".join(run[k + 1 :]) + texts[skip + j] for j, run in enumerate(runs) for k in range(len(run))]
        base = begin
    return texts


def _folded(digest: str, index: int, levels: list[tuple[int, list[list[str]]]], arity: int) -> str:
    for begin, runs in levels:
        run, k = runs[(index - begin) // arity], index % arity
        digest = digest_of((*run[:k], digest, *run[k + 1 :]))
        index //= arity
    return digest


def prove(leaves: pa.Table, nodes: pa.Table, arity: int) -> pa.Table:
    """Digests, proofs and roots of one range of leaves; `nodes` are those of its paths that lie outside it."""
    outer: dict[str, dict[tuple[int, int], str]] = defaultdict(dict)
    for tree, level, index, digest in zip(*(nodes[c].to_pylist() for c in ("tree", "level", "index", "digest"))):
        outer[tree][level, index] = digest
    own = list(_slices(leaves))
    below = [paths(x["place"][0].as_py(), x["leaf"].to_pylist(), x["total"][0].as_py(), outer[x["tree"][0].as_py()], arity) for x in own]
    top_first, top_total = own[0]["top_place"][0].as_py(), own[0]["top_total"][0].as_py()
    top, root = paths(top_first, [r for _, r in below], top_total, outer[TOP], arity)
    skipped = top_first - top[0][0] if top else 0
    above = _siblings(top, "", arity)
    out = []
    for k, (x, (levels, subroot)) in enumerate(zip(own, below)):
        first = x["place"][0].as_py()
        texts = _siblings(levels, above[skipped + k], arity)
        drop = first - levels[0][0] if levels else 0
        kept, sent = x["leaf"].to_pylist(), x["forged"].to_pylist()
        proofs = [hashlib.sha256(t.encode()).hexdigest() for t in texts[drop : drop + len(x)]]
        folded = [_folded(_folded(f or d, first + i, levels, arity), top_first + k, top, arity) for i, (d, f) in enumerate(zip(kept, sent))]
        whole = [f == root for f in folded]
        out.append(pa.table([x["id"], x["leaf"], pa.array([subroot] * len(x)), pa.array([root] * len(x)), pa.array(proofs), pa.array(folded), pa.array(whole)], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]))
    return pa.concat_tables(out)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text", arity: int = 8, modulus: int = 3, rows: int = RANGE, fan: int = FAN) -> DataFrame:
    """id, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root` and `verified` of each row.

    `folded_root` is what the row's proof gives for the row as received: with the A-Z of its text in lower case where `modulus`
    divides the CRC-32 of its id. `rows` is the size of a range, `fan` the number of fragments merged at a time.
    """
    ship(docs.sparkSession)
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0
    # a row's digest is worked out once: everything after this reads a narrow table
    found = stored(leaves(docs, id_col, group_col, fields, text_col, tampered), "manifest-leaves")
    placed = numbered(found, [F.col("id"), F.col("leaf")], "manifest-places", "tree", rows)
    nodes, subroots = reduce_forest(placed, arity, "manifest", fan)
    subroots = stored(subroots, "manifest-subroots")
    tops = numbered(subroots.withColumn("__top", F.lit(TOP)), [F.col("tree")], "manifest-groups", "__top", rows)
    tops = stored(tops.select(F.col("tree").alias("group"), F.col("__top").alias("tree"), "leaf", "part", "place", "total"), "manifest-top")
    top_nodes, _ = reduce_forest(tops, arity, "manifest-root", fan, every=True)

    spans = placed.groupBy("part", "tree").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.first("total").alias("total"))
    groups = tops.select(F.col("group").alias("tree"), F.col("place").alias("top_place"), F.col("total").alias("top_total"))
    ahead = stored(spans.join(groups, "tree"), "manifest-spans")
    over = ahead.groupBy("part").agg(F.min("top_place").alias("low"), F.max("top_place").alias("high"), F.first("top_total").alias("total"), F.lit(TOP).alias("tree"))
    wanted = ahead.select("part", "tree", "low", "high", "total").unionByName(over).withColumn("need", F.explode(_runs(F.col("low"), F.col("high"), F.col("total"), arity)))
    wanted = wanted.select("part", "tree", "need.level", "need.run")
    known = nodes.unionAll(top_nodes).withColumn("run", F.floor(F.col("index") / arity))
    outside = wanted.join(known, ["tree", "level", "run"]).select("part", "tree", "level", "index", "digest")

    own = placed.join(ahead.select("part", "tree", "top_place", "top_total"), ["part", "tree"])
    kinds = f"id {found.schema['id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    proved = own.groupBy("part").cogroup(outside.groupBy("part")).applyInArrow(lambda a, b: prove(a, b, arity), kinds)
    return proved.withColumnRenamed("id", id_col)
