"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

A document is the set of hashes of its runs of SHINGLE words (a shorter text is one shingle of all its words). Documents
with equal sets are one class, told by the hash of its set. A class has TREES keys of DEPTH minimum hashes each, written as
bytes so that their order is that of a prefix trie; the forest is the written table of these keys, sorted by tree and key,
without those that share not even the shortest prefix with another class.

Matching starts from whole keys: classes that share a prefix of p hashes in a tree are candidates, and connected ones make a
cell, whose sets are compared exactly, in blocks of classes two at a time. A pair of similarity s shares such a prefix with
probability 1 - (1 - s^p)^TREES. The similarities found tell how far to go: while the least similar of them would have been
found with less than the target recall, the prefix is shortened to the longest one that finds such pairs with it, and
matching is done again. The first prefixes find a pair at the threshold with 0.988, so that pairs of a similarity exist and
none is seen has probability 0.012 to the power of their number. Only link counts and the edges of a spanning forest leave a
task, never all pairs.

Cases: words are as written, separated by [\\x20\\x09-\\x0D]; null and empty texts link with nothing; similarity equal to
the threshold links; the smallest id stands for a group; null ids come last: a group of null ids only has component null,
and each of its rows is kept; rows that repeat an id are members of their own; an empty table gives an empty table; other
columns are not read, and may have any name. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, gram, mix, partitions, ship, stored, text_view
from .components import connected_components, thinned, tie
from .repeats import LAST

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 24, 8
#: Classes of a block, and shingles that a block holds at most before it is cut.
BLOCK = 512
#: Shingles counted at a time in a comparison of two blocks.
COLUMNS = 4_096
#: Bits of the broadcast map of wanted documents for each of them, and at most (16 MB); beyond, they are found by a join.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Similarities are told in steps of 1 / STEPS.
STEPS = 200


def prefix_length(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that finds a pair of this similarity with at least this chance; 1 if none does."""
    for p in range(depth, 1, -1):
        if 1 - (1 - similarity**p) ** trees >= recall:
            return p
    return 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents one after another, and their bounds."""
    w = Words(data, offsets)
    n, docs = w.counts, len(offsets) - 1
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    owner = w.owner
    g = mix(gram(w.hash, size))
    whole = np.arange(len(w.hash)) + size <= w.bounds[1:][owner]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        for d in short:
            h = np.uint64(n[d])
            for x in w.hash[w.bounds[d] : w.bounds[d + 1]]:
                h = mix(np.array([h ^ x]))[0]
            at = w.bounds[d]
            g[at], whole[at] = h, True
    g, owner = g[whole], owner[whole]
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1]))
    g, owner = g[fresh], owner[fresh]
    return g, np.searchsorted(owner, np.arange(docs + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """`count` minimum hashes of each non-empty set (rows in order)."""
    rng = np.random.default_rng(20240229)
    multipliers = rng.integers(1, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    adders = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.empty((len(full), count), np.uint32)
    high, low = (sets >> np.uint64(32)).astype(np.uint32), sets.astype(np.uint32)
    at = bounds[:-1][full]
    for c in range(count):
        # odd multiples of both halves keep values of different orders apart
        x = high * multipliers[c] + adders[c]
        x ^= low * multipliers[count - 1 - c]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        out[:, c] = np.minimum.reduceat(x, at)
    return out


def compare(a: list[np.ndarray], b: list[np.ndarray], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b; i < j if the blocks are the same) whose Jaccard similarity reaches `threshold`, and the similarity."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    row_a, row_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    if same:
        values, column, seen = np.unique(all_a, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(seen > 1)
        column_b = column
    else:
        values = np.intersect1d(all_a, all_b)
        shared = np.arange(len(values))
        column, column_b = (np.searchsorted(values, x) for x in (all_a, all_b))
        ok = [np.flatnonzero(values[np.minimum(c, max(len(values) - 1, 0))] == x) if len(values) else np.zeros(0, int) for c, x in ((column, all_a), (column_b, all_b))]
        row_a, column, row_b, column_b = row_a[ok[0]], column[ok[0]], row_b[ok[1]], column_b[ok[1]]
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column, column_b = place[column], place[column_b]
    common = np.zeros((len(a), len(b)), np.float32)
    order_a, order_b = np.argsort(column, kind="stable"), np.argsort(column_b, kind="stable")
    sorted_a, sorted_b = column[order_a], column_b[order_b]
    for c in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - c)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, order, ranked, rows in ((x, order_a, sorted_a, row_a), (y, order_b, sorted_b, row_b)):
            part = order[np.searchsorted(ranked, c) : np.searchsorted(ranked, c + width)]
            m[rows[part], (column if m is x else column_b)[part] - c] = 1
        live_a, live_b = np.flatnonzero(x.any(1)), np.flatnonzero(y.any(1))
        common[np.ix_(live_a, live_b)] += x[live_a] @ y[live_b].T
    union = size_a[:, None] + size_b[None, :] - common
    i, j = np.nonzero((common > 0) & (common >= threshold * union - 1e-6))
    # the bound above may let a rounding pass: decide by whole numbers
    inter, uni = np.rint(common[i, j]).astype(np.int64), np.rint(union[i, j]).astype(np.int64)
    ok = inter >= np.ceil(np.round(threshold * uni, 9)).astype(np.int64)
    if same:
        ok &= i < j
    return i[ok], j[ok], inter[ok] / uni[ok]


def id_map(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits set at the hashed places of ids; bits / 64 rows at most come to the driver."""
    slots = ids.select(slot_of(column, bits).alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint8)


def slot_of(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")


def of_wanted(rows: DataFrame, wanted: DataFrame, work, schema: str) -> DataFrame:
    """`work` on the batches of those rows whose doc is a `first` of `wanted`, and few others: by a map of hashed ids where it fits MOST_BITS, else by a join."""
    names = rows.columns
    bits = 1 << max(6, (BITS_EACH * wanted.count()).bit_length())
    if bits > MOST_BITS:
        return rows.join(wanted.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi").select(names).mapInArrow(work, schema)
    shared = rows.sparkSession.sparkContext.broadcast(id_map(wanted, "first", bits))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(shared.value, bitorder="little")
        return work(batch.filter(pa.array(marked[batch.column(len(names)).to_numpy()] > 0)).select(names) for batch in batches)

    return rows.select("*", slot_of("doc", bits).alias("__slot")).mapInArrow(picked, schema)


_NODE = "struct<first:bigint,rep:bigint>"


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row a document: id, n_links (other documents at least so similar), component_id (smallest id reachable), kept, text_key (hash of the text)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(id_col).alias("__id"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """A part of a batch, its sets and their bounds, and two hashes of each set: equal sets have equal sums of scrambled values (128 bits)."""
        for batch in batches:
            data, offsets = text_view(batch.column("text"))
            for i, j in chunks(offsets, 1 << 21):
                sets, bounds = shingle_sets(data, offsets[i : j + 1], size)
                full = np.flatnonzero(np.diff(bounds) > 0)
                same = np.zeros((j - i, 2), np.uint64)
                if len(full):
                    at = bounds[:-1][full]
                    same[full, 0] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    same[full, 1] = np.add.reduceat(mix(sets + np.uint64(0x1234567890ABCDEF)), at)
                yield batch.slice(i, j - i), sets, bounds, same.view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, bounds, same in sets_of(batches):
            n = np.diff(bounds)
            keys = np.zeros((len(n), TREES * DEPTH), ">u2")
            keys[n > 0] = (signatures(sets, bounds, TREES * DEPTH) >> np.uint32(16)).astype(">u2")
            flat = pa.Array.from_buffers(pa.binary(), len(n) * TREES, [None, pa.py_buffer(np.arange(0, len(n) * TREES * DEPTH * 2 + 1, DEPTH * 2, dtype=np.int32).tobytes()), pa.py_buffer(keys.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES, pa.int32()), flat)
            columns = [part.column("doc"), part.column("__id"), part.column("text_key"), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(n.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "__id", "text_key", "same_a", "same_b", "n", "keys"])

    signed = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(sign, f"doc long, __id {id_type}, text_key long, same_a long, same_b long, n int, keys array<binary>")
    # signatures are kept; sets are made again for those classes that have candidates, which are few
    light = stored(signed, "signatures")
    classes = light.filter("n > 0").groupBy("same_a", "same_b").agg(F.min("doc").alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("node", F.struct("first", F.col("same_a").alias("rep"))), "classes")
    parts = partitions(spark)

    # the forest: keys in the order of their tries, of the classes that meet another at the shortest prefix there can be
    prefix = lambda p: F.substring("key", 1, 2 * p).alias("prefix")
    shortest = prefix_length(similarity, recall)
    leaves = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    met = leaves.groupBy("tree", prefix(shortest)).agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    forest = stored(leaves.withColumn("prefix", prefix(shortest)).join(met, ["tree", "prefix"], "left_semi").select("node", "tree", "key").sortWithinPartitions("tree", "key"), "forest")

    # one document of each of these classes brings its set
    wanted = stored(classes.select("node", "first", "same_a", "same_b", "copies").join(forest.select("node").distinct(), "node", "left_semi"), "wanted")

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, bounds, same in sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(same[:, 0]), pa.array(same[:, 1]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))], ["same_a", "same_b", "shingles"])

    sets = of_wanted(rows, wanted, set_rows, "same_a long, same_b long, shingles array<long>").dropDuplicates(["same_a", "same_b"])
    sets = stored(wanted.join(sets, ["same_a", "same_b"]).select("node", "copies", "shingles"), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, i, j); one group is held at a time."""
        held: list[pa.RecordBatch] = []
        held_key = None
        out: list[list] = [[], [], []]

        def finish() -> None:
            t = pa.Table.from_batches(held)
            block, copies = t.column("block").to_numpy(), t.column("copies").to_numpy()
            node = t.column("node").combine_chunks()
            first, rep = (node.field(c).to_numpy() for c in (0, 1))
            order = np.lexsort((rep, first))
            block, first, rep, copies = block[order], first[order], rep[order], copies[order]
            lists = t.column("shingles").combine_chunks()
            flat, offs = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x = [flat[offs[k] : offs[k + 1]] for k in order.tolist()]
            _, _, i, j = held_key
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right) or len(rep) < 2:
                return
            p, q, similar = compare([x[k] for k in left], [x[k] for k in right], i == j, similarity)
            if not len(p):
                return
            p, q = left[p], right[q]
            links = np.bincount(p, copies[q], len(rep)) + np.bincount(q, copies[p], len(rep))
            label = tie(np.arange(len(rep)), p, q)
            name = lambda k: {"first": int(first[k]), "rep": int(rep[k])}
            for k in np.flatnonzero(links).tolist():
                put(name(k), None, int(links[k]))
            for s in np.flatnonzero(label != np.arange(len(label))).tolist():
                put(name(s), name(int(label[s])), None)
            put(None, None, int(np.floor(similar.min() * STEPS + 1e-9)))

        def put(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def emit() -> pa.RecordBatch:
            node = pa.struct([("first", pa.int64()), ("rep", pa.int64())])
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (node, node, pa.int64()))], ["node", "other", "links"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            cell = batch.column("cell")
            key = np.stack([*(cell.field(c).to_numpy() for c in (0, 1)), batch.column("i").to_numpy(), batch.column("j").to_numpy()], 1)
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else np.zeros(0, int)
            for e, f in zip(edges, np.append(edges[1:], len(key))):
                now = tuple(key[e].tolist())
                if held and now != held_key:
                    finish()
                    held.clear()
                held_key = now
                held.append(batch.slice(e, f - e))
            yield emit()
        if held:
            finish()
        yield emit()

    def matched(p: int) -> DataFrame:
        """Links (other null), edges of spanning forests (links null) and the least similarities (node null) among classes that share a prefix of p hashes."""
        # each class points at the smallest class of every subtree that it is in, so an edge is made for a member, not for a pair
        least = forest.groupBy("tree", prefix(p)).agg(F.min("node").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
        star = forest.withColumn("prefix", prefix(p)).join(least, ["tree", "prefix"]).select("node", "least").filter("node <> least")
        # a member of a group is in a subtree of each tree, with as many least classes: one edge for each member is enough
        cells = connected_components(thinned(star, "node", "least"), "node", "least").withColumnRenamed("component", "cell")
        sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
        # block i meets block j >= i in the task (cell, i, j); small cells share tasks by their hash
        tasks = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "cell", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "copies", "shingles"
        )
        checked = tasks.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(verify, f"node {_NODE}, other {_NODE}, links long")
        return stored(checked, "links")

    depth = DEPTH
    while True:
        links = matched(depth)
        found = links.filter("node is null").agg(F.min("links")).first()[0]
        enough = depth if found is None else prefix_length(max(found / STEPS, similarity), recall, depth=depth)
        if enough == depth:
            break
        depth = enough

    counts = links.filter("node is not null and other is null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(thinned(links.filter("other is not null"), "node", "other"), "node", "other")
    known = classes.select("node", "first", "same_a", "same_b", "copies").join(counts, "node", "left").join(groups, "node", "left")
    known = known.select("same_a", "same_b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component.first", "first").alias("component_id"))
    found = light.select("doc", "__id", "text_key", "same_a", "same_b", "n").join(known, ["same_a", "same_b"], "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc")).otherwise(F.col("component_id"))
    return found.select(
        F.col("__id").alias(id_col), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.nullif(component, F.lit(LAST)).alias("component_id"), (component == F.col("doc")).alias("kept"), "text_key",
    )
