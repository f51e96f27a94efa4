"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a shuffled order (by a hash of the text's id) and laid end to end on a line of words,
which is cut into equal blocks of BLOCK words at most, LEAST_BLOCKS at least where there are as many words. Slot i of the
schedule is the point frac(1/2 + i * golden ratio) on the cumulative weights of the sources, so every prefix of the schedule
keeps each source near its share. A source has as many slots as its target holds blocks: points beyond that number are
left out, and where the points gave it fewer, its next ones follow at the end. A slot's rank among its source's slots, modulo
the source's blocks, is the block it takes; a document is taken by the words that its blocks cover, as often as they come up.

Running sums over a source (a third of all rows may be one source) go in two levels: sums of SPANS x buckets first, then
the order inside a bucket, so that no task holds a source. `mix` is DataFrame expressions; `mixed_texts` cuts the texts in
Arrow batches.

Cases: a null text has size 0; documents of size 0 take nothing; a null source is a source, ordered last; sources of size
0 have target 0; a null id is an id; equal order keys are settled by the id; rows repeated with one id are laid down and
returned one by one; an empty table gives an empty table; other columns are not read, and may have any name. The limit
`most` is a whole number, as it limits how often a block comes up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, ship, stored, text_view

#: The golden ratio's fraction as 31-bit fixed point: points are exact for any slot number.
ONE, GOLDEN = 1 << 31, 1327217885
#: Words of a block at most. Slots, and rows that carry them, are the mix's words divided by this.
BLOCK = 256
#: Blocks of a source at least, as far as it has words: rounding to whole blocks costs a small source 1 / 80 of its size at most.
LEAST_BLOCKS = 40
#: Equal rows that one array numbers.
EQUAL = 4_096
#: Rows of a source, and slots of the schedule, that one bucket of a running sum holds on average.
PER_BUCKET = 2_000
SLOTS_PER_BUCKET = 20_000


def size_of(text: Column) -> Column:
    """Number of words ([^\\x20\\x09-\\x0D]+), 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: list[tuple[object, int]], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Target words of each source: `share` of all words, by weight, none above `most` times its size, the excess reshared.

    `sources` is one (name, size) a source, ordered; as many rows as there are sources.
    """
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(sources)}
    size = dict(sources)
    left = share * sum(size.values())
    free, out = list(size), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def blocks_of(size: int, block: int) -> int:
    return max(1, -(-size // block), min(size, LEAST_BLOCKS))


def laid_out(docs: DataFrame, n_rows: int) -> DataFrame:
    """`first_word` of every row on its source's line, by two levels of sums over columns source_key, order_key, size."""
    buckets = max(1, n_rows // PER_BUCKET)
    placed = docs.withColumn("bucket", F.pmod(F.shiftrightunsigned("order_key", 1), F.lit(buckets)))
    in_bucket = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    # one row a source and bucket; buckets are summed in spans first
    spans = max(1, int(buckets**0.5))
    in_bucket = in_bucket.withColumn("span", F.floor(F.col("bucket") / spans))
    in_span = in_bucket.groupBy("source_key", "span").agg(F.sum("bucket_size").alias("span_size"))
    before = Window.partitionBy("source_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    in_span = in_span.withColumn("span_start", F.coalesce(F.sum("span_size").over(before), F.lit(0)))
    before = Window.partitionBy("source_key", "span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_bucket.withColumn("in_span", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(in_span, ["source_key", "span"]).select("source_key", "bucket", (F.col("span_start") + F.col("in_span")).alias("bucket_start"))
    before = Window.partitionBy("source_key", "bucket").orderBy("order_key", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("in_bucket", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return inside.join(starts, ["source_key", "bucket"]).withColumn("first_word", F.col("bucket_start") + F.col("in_bucket")).drop("bucket", "bucket_start", "in_bucket")


def schedule(spark, sources: list[dict]) -> DataFrame:
    """(source_key, block, times): the slots that take each block. `sources`: key, blocks, slots."""
    n = total = sum(s["slots"] for s in sources)
    if not n:
        return spark.createDataFrame([], "source_key string, block long, times long")
    edges, at = [], 0
    for s in sources:
        at += s["slots"]
        edges.append((at / total, s["key"], s["blocks"]))
    table = F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(k).alias("key"), F.lit(b).cast("long").alias("blocks")) for e, k, b in edges]) if len(edges) <= 1000 else None
    point = F.pmod(F.pmod(F.col("id"), F.lit(ONE)) * F.lit(GOLDEN) + F.lit(ONE // 2), F.lit(ONE))
    slots = spark.range(n).withColumn("point", point / F.lit(float(ONE)))
    if table is not None:
        # the first source whose edge lies beyond the point: a binary search would do no better on so few
        slots = slots.withColumn("s", F.coalesce(F.element_at(F.filter(F.lit(table), lambda x: x["edge"] > F.col("point")), 1), F.element_at(table, -1)))
    else:
        cells = 4 * len(edges)
        low = [0.0, *[e for e, _, _ in edges[:-1]]]
        rows = [(c, a, e, k, b) for a, (e, k, b) in zip(low, edges) for c in range(int(a * cells), min(int(e * cells), cells - 1) + 1)]
        near = spark.createDataFrame(rows, "cell long, low double, edge double, key string, blocks long")
        slots = slots.withColumn("cell", F.floor(F.col("point") * cells)).join(near, "cell").filter("point >= low and point < edge").withColumn("s", F.struct("edge", "key", "blocks"))
    slots = slots.select("id", F.floor(F.col("id") / SLOTS_PER_BUCKET).alias("bucket"), F.col("s.key").alias("source_key"), F.col("s.blocks").alias("blocks"))
    counts = slots.groupBy("source_key", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = slots.withColumn("in_bucket", F.row_number().over(Window.partitionBy("source_key", "bucket").orderBy("id")) - 1).join(starts, ["source_key", "bucket"])
    held = spark.createDataFrame([(s["key"], s["slots"], s["blocks"]) for s in sources], "source_key string, slots long, held long")
    ranked = ranked.select("source_key", (F.col("start") + F.col("in_bucket")).alias("rank")).join(held, "source_key").filter("rank < slots")
    dealt = counts.groupBy("source_key").agg(F.sum("n").alias("dealt"))
    # a source lacks a few slots at most: the points' discrepancy, which grows like the logarithm of their number
    short = held.join(dealt, "source_key", "left").filter("slots > coalesce(dealt, 0)")
    short = short.select("source_key", "held", F.explode(F.sequence(F.coalesce("dealt", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    slots = ranked.select("source_key", "held", "rank").unionByName(short)
    return slots.select("source_key", F.pmod("rank", "held").alias("block")).groupBy("source_key", "block").agg(F.count("*").alias("times"))


def identified(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """`docs` with source_key, size, and text_key, a hash of the text: equal in all three and the id means equal here."""
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    return docs.withColumns({"__source_key": key, "__size": size_of(text), "__text_key": F.xxhash64(text)})


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows on their sources' lines, facts of sources, and (row_id, from_word, words, times): what the schedule takes of each."""
    if most != int(most) or most < 1:
        raise ValueError("most must be a whole number, 1 at least")
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col, source_col).select(F.col(id_col), F.col("__source_key").alias("source_key"), F.col("__size").alias("size"), F.col("__text_key").alias("text_key"))
    # equal rows are counted where they are read and told apart by their number among equals, which any run gives alike
    equal = rows.groupBy(id_col, "source_key", "size", "text_key").agg(F.count("*").alias("__n"))
    equal = equal.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(EQUAL).cast("long"))))
    equal = equal.withColumn("__number", F.explode(F.sequence(F.col("__first") + 1, F.least(F.col("__n"), F.col("__first") + EQUAL))))
    rows = equal.withColumn("row_id", F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "source_key", "size", "text_key", "__number")).withColumn("order_key", F.xxhash64("row_id")).drop("__n", "__first", "__number")
    rows = stored(rows, "mix-sizes")
    found = rows.groupBy("source_key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    ordered = sorted(found, key=lambda r: (r.source_key == "null", r.source_key))
    size = {r.source_key: r["size"] for r in ordered}
    wanted = targets([(r.source_key, r["size"]) for r in ordered], weights, share, most)
    sources = []
    for k, n in size.items():
        if n:
            blocks = blocks_of(n, block)
            sources.append({"key": k, "blocks": blocks, "slots": round(wanted[k] * blocks / n)})
    facts = spark.createDataFrame([(k, n, wanted[k], blocks_of(n, block)) for k, n in size.items()], "source_key string, source_size long, target double, blocks long")
    taken_blocks = schedule(spark, sources)
    line = laid_out(rows, sum(r.n for r in ordered)).join(facts, "source_key")
    # block b covers the words from floor(b * size / blocks) to floor((b + 1) * size / blocks)
    edge = lambda b: F.floor(b * F.col("source_size") / F.col("blocks"))
    at = lambda w: F.floor((w * F.col("blocks") + F.col("blocks") - 1) / F.col("source_size"))
    first = F.greatest(at(F.col("first_word")) - 1, F.lit(0))
    last = F.least(at(F.col("first_word") + F.col("size") - 1) + 1, F.col("blocks") - 1)
    cut = line.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("first_word"), edge(F.col("block")))
    cut = cut.withColumn("words", F.least(F.col("first_word") + F.col("size"), edge(F.col("block") + 1)) - begin).filter("words > 0").withColumn("from_word", begin - F.col("first_word"))
    taken = cut.join(taken_blocks, ["source_key", "block"]).select(id_col, "source_key", "size", "text_key", "row_id", "from_word", "words", F.least("times", F.lit(int(most))).alias("times"))
    return rows, facts, taken


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """One row a document: id, size, source_size, target (its source's), taken (words that the mix takes of it)."""
    rows, facts, taken = _taken(docs, id_col, text_col, source_col, weights, share, most, block)
    taken = taken.groupBy("row_id").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    everything = rows.join(facts, "source_key", "left").join(taken, "row_id", "left")
    return everything.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def runs_taken(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Longest spans of words, layer by layer (taken once at least, twice at least, ...), from (from_word, words, times)."""
    out: list[tuple[int, int]] = []
    pieces = sorted(pieces)
    for layer in range(1, max((t for _, _, t in pieces), default=0) + 1):
        fresh = True
        for begin, n, times in pieces:
            if times < layer:
                continue
            if not fresh and out[-1][1] == begin:
                out[-1] = (out[-1][0], begin + n)
            else:
                out.append((begin, begin + n))
            fresh = False
    return out


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """The columns of `docs`, a row for each span of words that the mix takes: text is the part of the text that holds them.

    Neighbouring blocks make one span, so a document that is taken once as a whole stays one row with its whole text; the
    first span keeps what stands before the first word, the last one what stands behind the last. Equal rows (id, source and
    text) share their spans.
    """
    ship(docs.sparkSession)
    _, _, taken = _taken(docs, id_col, text_col, source_col, weights, share, most, block)
    keys = ["__id", "__source_key", "__size", "__text_key"]
    renamed = taken.select(F.struct(F.col(id_col).alias("id")).alias("__id"), *[F.col(c).alias(f"__{c}") for c in ("source_key", "size", "text_key")], F.struct("row_id", "from_word", "words", "times").alias("piece"))
    spans = renamed.groupBy(*keys).agg(F.collect_list("piece").alias("__pieces"))
    held = identified(docs, id_col, text_col, source_col).withColumn("__id", F.struct(F.col(id_col).alias("id"))).dropDuplicates(keys)
    names, place = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(place))
            rows, texts, size = [], [], 0
            pieces = batch.column(len(names)).to_pylist()
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]]
                start = np.append(Words(raw, np.array([0, len(raw)]), hashes=False).start, len(raw))
                start[0] = 0
                by_row: dict[str, list] = {}
                for p in pieces[r]:
                    by_row.setdefault(p["row_id"], []).append((p["from_word"], p["words"], p["times"]))
                for k in sorted(by_row):
                    for a, b in runs_taken(by_row[k]):
                        rows.append(r)
                        texts.append(raw[start[a] : start[b]].tobytes())
                        size += len(texts[-1])
                if size > 4_000_000 or r + 1 == batch.num_rows:
                    made = batch.select(names).take(pa.array(rows, pa.int64()))
                    columns = made.columns
                    columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names)
                    rows, texts, size = [], [], 0

    return held.join(spans, keys).select(*names, "__pieces").mapInArrow(cut, T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]))
