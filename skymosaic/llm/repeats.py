"""Windows of `width` units that repeat in a collection: the plan shared by the word and the byte operator.

1. Every window is owned by its anchor, the gram of `gram` units with the least hash in it; consecutive windows with one
   anchor make a run. Two equal windows have equal anchors, so only runs of equal anchors need to be compared.
2. A task folds its own runs first: hashes propose runs that may be equal, their texts are compared, and of those that are
   equal only the earliest travels; the others are covered at once. So an anchor that a third of all documents hold sends
   one row a block of texts, not one a document.
3. Rows meet by anchor, sorted, one anchor at a time. Anchors that one row holds are done; all others are sent for their
   texts (at most 2 * width - gram units each).
4. Texts meet by anchor again and are compared by the operator's own index (suffix automaton or column-wise suffix
   sorting), which alone decides what is removed. Equal texts of an anchor enter the index once, with all their owners. An
   anchor with more than `hot` rows is dealt by its single windows instead, equal ones folded within each task, so no
   index grows with the data.
5. Covered spans are gathered by document.

Rows with one id and different texts are told apart by a hash of the text; equal rows share their spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, gram, mix, partitions, powers, ship, sliding_min, stored, text_view

#: Runs, and bytes of text, that a task folds at a time.
FOLD_RUNS, FOLD_BYTES = 500_000, 24_000_000
#: Bytes of texts that one index holds; an anchor's rows stay together, `hot` of them at most.
SHARD_BYTES = 1 << 18
#: Windows of hot anchors that a task folds at a time, and bytes that are compared in one step.
FOLD_WINDOWS, STEP_BYTES = 50_000, 1 << 22
LAST = (1 << 63) - 1
_BASE = 0xC2B2AE3D27D4EB4F
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Plan:
    width: int
    gram: int
    words: bool  # units are words, else bytes
    within: bool  # an earlier place of the same document counts
    #: (distinct passages; passage, document and start of each owner; width) -> (owner, first window, last window) arrays to be covered
    shard: Callable
    hot: int = 1_000


def units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, Words | None]:
    if words:
        w = Words(data, offsets)
        return w.hash, w.bounds, w
    return BYTE_HASH[data[offsets[0] : offsets[-1]]], offsets - offsets[0], None


def runs(h: np.ndarray, bounds: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first window, the same counted from the first document on, windows, anchor, hash of the whole run) of every run."""
    n = len(h)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(np.arange(n) + width <= bounds[1:][owner])
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    g = mix(gram(h, k))
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    least = sliding_min((g & ~low) | np.arange(n, dtype=np.uint64), width - k + 1)
    anchor = (least[start] & low).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(fresh)
    first, count = start[at], np.diff(np.append(at, len(start)))
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_BASE, n), out=running[1:])
    end = first + count - 1 + width
    whole = (running[end] - running[first]) * powers(pow(_BASE, -1, 1 << 64), n)[first]
    doc = owner[first]
    return doc, first - bounds[doc], first, count, g[anchor[at]], mix(whole + (end - first).astype(np.uint64))


def merged(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each key, overlapping and touching ones joined."""
    if not len(key):
        return key, begin, end
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    new_key = np.append(True, key[1:] != key[:-1])
    lift = (np.cumsum(new_key) - 1) * (int(end.max()) + 1)  # keys never mix: each lifts the line anew, by its number and the longest end
    reach = np.maximum.accumulate(end + lift) - lift
    fresh = new_key.copy()
    fresh[1:] |= begin[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return key[at], begin[at], reach[np.append(at[1:], len(key)) - 1]


def later(doc: np.ndarray, start: np.ndarray, group: np.ndarray, within: bool) -> np.ndarray:
    """Whether each row has an earlier one in its group; rows are sorted by group, document and start."""
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(group)), 0))
    after = doc > doc[head]
    return after | ((doc == doc[head]) & (start > start[head])) if within else after


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes (1 at least) from each a equal those from b."""
    out = np.empty(len(a), bool)
    ends = np.append(0, np.cumsum(size))
    for i, j in chunks(ends, STEP_BYTES):
        at = ends[i:j] - ends[i]
        step = np.arange(ends[j] - ends[i]) - np.repeat(at, size[i:j])
        out[i:j] = np.logical_and.reduceat(data[np.repeat(a[i:j], size[i:j]) + step] == data[np.repeat(b[i:j], size[i:j]) + step], at)
    return out


def same_text(data: np.ndarray, begin: np.ndarray, end: np.ndarray, one: np.ndarray, other: np.ndarray, words: bool) -> np.ndarray:
    """Whether the spans `one` and `other` (places in begin and end) hold equal units; words may be parted differently."""
    size = end - begin
    out = size[one] == size[other]
    out[out] = same_bytes(data, begin[one[out]], begin[other[out]], size[one[out]])
    if words:
        text = lambda i: data[begin[i] : end[i]].tobytes().split()
        for k in np.flatnonzero(~out).tolist():
            out[k] = text(one[k]) == text(other[k])
    return out


def groups_of(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that stream by sorted on column `key`, as tables of whole groups, and where the groups begin; the last group waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        at = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            at = np.append(0, at)
        if len(at):
            rows = pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
            held = []
            if rows.num_rows:
                yield rows, edges(rows.column(key).to_numpy())
            batch = batch.slice(int(at[-1]))
        held.append(batch)
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, edges(rows.column(key).to_numpy())


def edges(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, k[1:] != k[:-1]))


_NAMES = ["anchor", "doc", "twin", "a", "b"]
_ROWS = "anchor long, doc long, twin long, a int, b int"
_TEXTS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int32()), ("units", pa.binary())])


def _spans(doc, twin, begin, end) -> pa.RecordBatch:
    """Covered spans: rows without an anchor."""
    doc, twin = np.asarray(doc, np.int64), np.asarray(twin, np.int64)
    order = np.lexsort((twin, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (twin[order][1:] != twin[order][:-1])
    names = order[fresh]
    key = np.empty(len(doc), np.int64)
    key[order] = np.cumsum(fresh) - 1
    key, begin, end = merged(key, np.asarray(begin, np.int64), np.asarray(end, np.int64))
    doc, twin = doc[names][key], twin[names][key]
    return pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), *(pa.array(x) for x in (doc, twin, begin.astype(np.int32), end.astype(np.int32)))], _NAMES)


def covered_spans(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc, twin, begin, end) of units to remove, from the columns of `keyed`; spans may overlap."""
    spark = docs.sparkSession
    width, k, within, words, shard, hot = plan.width, plan.gram, plan.within, plan.words, plan.shard, plan.hot

    def fold(parts: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, twin, a, n, anchor, seg, begin, end = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((a, doc, seg))
        doc, twin, a, n, anchor, seg, begin, end = (x[order] for x in (doc, twin, a, n, anchor, seg, begin, end))
        fresh = np.append(True, seg[1:] != seg[:-1])[: len(seg)]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(seg)), 0))
        gone = later(doc, a, seg, within)
        ask = np.flatnonzero(gone)
        gone[ask] = same_text(np.concatenate(texts), begin, end, ask, head[ask], words)
        yield _spans(doc[gone], twin[gone], a[gone], a[gone] + n[gone] - 1 + width)
        keep = ~gone
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, doc, twin, a.astype(np.int32), n.astype(np.int32))], _NAMES)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, size, read = [], [], 0, 0
        for batch in batches:
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, offsets = text_view(batch.column(2))
            for i, j in chunks(offsets, 1 << 20 if not words else 1 << 21):
                h, bounds, w = units(data, offsets[i : j + 1], words)
                doc, first, at, count, anchor, seg = runs(h, bounds, width, k)
                last = at + count - 2 + width
                begin, end = (w.start[at], w.end[last]) if words else (at, last + 1)
                parts.append((ids[i:j][doc], twins[i:j][doc], first, count, anchor.view(np.int64), seg.view(np.int64), begin + read, end + read))
                texts.append(data[offsets[i] : offsets[j]])
                read += len(texts[-1])
                size += len(doc)
                if size > FOLD_RUNS or read > FOLD_BYTES:
                    yield from fold(parts, texts)
                    parts, texts, size, read = [], [], 0, 0
        if parts:
            yield from fold(parts, texts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, spans first; passes on spans, and the rows of anchors that several rows hold, marked where they are hot."""

        def out(rows: pa.Table, split: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from rows.append_column("split", pa.array(split)).combine_chunks().to_batches()

        def known() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from told(batch)

        spans: list[pa.RecordBatch] = []

        def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not valid.all():
                spans.append(batch.filter(pa.array(~valid)))
                batch = batch.filter(pa.array(valid))
            if batch.num_rows:
                yield batch

        flowing = None  # the hot anchor whose rows pass on as they come
        waiting: list[pa.RecordBatch] = []

        def pending() -> Iterator[pa.RecordBatch]:
            yield from waiting
            waiting.clear()

        for batch in known():
            while spans:
                x = spans.pop()
                yield from out(pa.Table.from_batches([x]), np.zeros(x.num_rows, bool))
            key = batch.column(0).to_numpy()
            if flowing is not None:
                n = int(np.searchsorted(key, flowing, "right"))
                if n:
                    yield from out(pa.Table.from_batches([batch.slice(0, n)]), np.ones(n, bool))
                    batch, key = batch.slice(n), key[n:]
                if not len(key):
                    continue
                flowing = None
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last anchor may go on
            if waiting and waiting[0].column(0)[0].as_py() != key[0] and not cut:
                yield from chosen(pa.Table.from_batches(list(pending())), out)
            if cut:
                yield from chosen(pa.Table.from_batches([*pending(), batch.slice(0, cut)]), out)
            waiting.append(batch.slice(cut))
            if sum(b.num_rows for b in waiting) > hot:
                flowing = int(key[-1])
                rows = pa.Table.from_batches(list(pending()))
                yield from out(rows, np.ones(rows.num_rows, bool))
        while spans:
            x = spans.pop()
            yield from out(pa.Table.from_batches([x]), np.zeros(x.num_rows, bool))
        if waiting:
            yield from chosen(pa.Table.from_batches(list(pending())), out)

    def chosen(rows: pa.Table, out: Callable) -> Iterator[pa.RecordBatch]:
        key, doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        at = edges(key)
        size = np.diff(np.append(at, len(key)))
        ask = size > 1
        if not within:  # several documents, too
            ask &= np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)
        ask, split = np.repeat(ask, size), np.repeat(size > hot, size)
        if ask.any():
            yield from out(rows.filter(pa.array(ask)), split[ask])

    parts = partitions(spark)
    told = docs.select("doc", "twin", "text").mapInArrow(propose, _ROWS).repartition(parts, F.coalesce("anchor", F.xxhash64("doc", "a"))).sortWithinPartitions("anchor")
    settled = stored(told.mapInArrow(settle, f"{_ROWS}, split boolean"), "repeats")
    spans = settled.filter("anchor is null").select("doc", "twin", F.col("a").alias("begin"), F.col("b").alias("end"))
    asked = settled.filter("anchor is not null").groupBy("doc", "twin").agg(F.collect_list(F.struct("anchor", "split", "a", "b")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the runs asked for; windows of hot anchors one by one, folded within the task. A later one is told by an empty text."""
        single: dict[bytes, list] = {}
        out: list[list] = [[], [], [], [], []]

        def put(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _TEXTS)], schema=_TEXTS)
            for c in out:
                c.clear()
            return batch

        def flush() -> None:
            for text, kept in single.items():
                for d, s, t, key in kept:
                    put(key, d, t, s, text)
            single.clear()

        def window(text: bytes, row: tuple) -> None:
            """Keeps the earliest rows of a text; the others are covered."""
            old = single.get(text)
            place = 2 if within else 1  # rows are at one place if they share the id, and the start where that counts
            if old is None or row[:place] < old[0][:place]:
                single[text] = [row]
                lost = old or []
            elif row[:place] == old[0][:place]:
                old.append(row)
                lost = []
            else:
                lost = [row]
            for d, s, t, _ in lost:
                put(d * 31 + s & LAST, d, t, s, b"")

        for batch in batches:
            data, offsets = text_view(batch.column("text"))
            lists = batch.column("asked")
            bounds, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            anchor, split, first, count = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(4))
            docs, twins = batch.column("doc").to_pylist(), batch.column("twin").to_pylist()
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                mine = slice(bounds[r], bounds[r + 1])
                if words:
                    seq = raw.split()
                    cut = lambda a, b: b" ".join(seq[a:b])  # noqa: B023,E731
                else:
                    cut = lambda a, b: raw[a:b]  # noqa: B023,E731
                windows = None
                for key, apart, a, n in zip(anchor[mine].tolist(), split[mine].tolist(), first[mine].tolist(), count[mine].tolist()):
                    if not apart:
                        put(key, docs[r], twins[r], a, cut(a, a + n - 1 + width))
                        continue
                    windows = mix(gram(units(data, offsets[r : r + 2], words)[0], width)).view(np.int64) if windows is None else windows
                    for p in range(a, a + n):
                        window(cut(p, p + width), (docs[r], p, twins[r], int(windows[p])))
                    if len(single) > FOLD_WINDOWS:
                        flush()
                if len(out[0]) > 20_000:
                    yield made()
            yield made()
        flush()
        yield made()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. Whole keys are packed into indices of bounded size; equal texts enter once."""
        names = ["doc", "twin", "begin", "end"]
        passages: list[bytes] = []
        which: list[int] = []
        held: list[tuple] = []
        load = 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal load
            if held:
                doc, twin, start = (np.concatenate(x) for x in zip(*held))
                owner, a, b = shard(passages, np.array(which, np.int64), doc, start, width)
                found = _spans(doc[owner], twin[owner], start[owner] + a, start[owner] + b + width)
                yield pa.RecordBatch.from_arrays(found.columns[1:], names)
            passages.clear(), which.clear(), held.clear()
            load = 0

        for rows, at in groups_of(batches, 0):
            doc, twin, start = (rows.column(c).to_numpy() for c in (1, 2, 3))
            texts = rows.column(4).to_pylist()
            told = np.flatnonzero([not t for t in texts])
            if len(told):
                found = _spans(doc[told], twin[told], start[told], start[told] + width)
                yield pa.RecordBatch.from_arrays(found.columns[1:], names)
            for i, j in zip(at.tolist(), np.append(at[1:], len(texts)).tolist()):
                mine = [r for r in range(i, j) if texts[r]]
                if len(mine) < 2:
                    continue
                place: dict[bytes, int] = {}
                for r in mine:
                    if texts[r] not in place:
                        place[texts[r]] = len(passages)
                        passages.append(texts[r])
                        load += len(texts[r])
                    which.append(place[texts[r]])
                held.append((doc[mine], twin[mine], start[mine].astype(np.int64)))
                if load > SHARD_BYTES:
                    yield from finish()
        yield from finish()

    texts = docs.join(asked, ["doc", "twin"])
    shuffled = texts.mapInArrow(fetch, "key long, doc long, twin long, start int, units binary").repartition(parts, "key").sortWithinPartitions("key")
    return spans.unionByName(shuffled.mapInArrow(compare, "doc long, twin long, begin int, end int"))


#: Repeated ids up to which their table (8 bytes each) is broadcast.
FEW_IDS = 100_000


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """doc (null ids come last), twin, id, text, and a struct of the columns in `carry`.

    `twin` tells the rows of one id apart: 60 bits of the SHA-256 of their text, and 0 where no other row has the id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(id_col).alias("__id"), text.alias("text"), F.struct(F.lit(0).alias("nothing"), *[F.col(c) for c in carry]).alias("__carry"))
    again = stored(rows.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("__again")), "repeated-ids")
    n = again.count()
    if not n:
        return rows.select("doc", F.lit(0).cast("long").alias("twin"), "__id", "text", "__carry")
    told = F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 15), 16, 10).cast("long")
    twin = F.when(F.col("__again").isNotNull(), told).otherwise(F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(again) if n <= FEW_IDS else again, F.col("doc") == F.col("__again"), "left")
    return joined.select("doc", twin.alias("twin"), "__id", "text", "__carry")


def remove(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, n_units, n_removed, spans (array of begin, end; units), kept (binary: what is left), and `carry`.

    Words that are left are joined by one space, bytes are concatenated.
    """
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, carry)
    words = plan.words
    spans = covered_spans(rows, plan)
    by_doc = spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    # both joins of the texts deal the same columns by the same key, so that one shuffle of the texts serves both
    joined = rows.join(by_doc, ["doc", "twin"], "left")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column("text"))
            total, removed, kept, lists = [], [], [], []
            begin = 0
            spans, ids, carried = (batch.column(c) for c in ("spans", "__id", "__carry"))
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                seq = raw.split() if words else raw
                found = []
                if spans[r].is_valid:
                    x = spans[r].as_py()
                    _, b, e = merged(np.zeros(len(x), np.int64), np.array([y["begin"] for y in x], np.int64), np.array([y["end"] for y in x], np.int64))
                    found = list(zip(b.tolist(), e.tolist()))
                left, at = [], 0
                for b, e in found:
                    left.append(seq[at:b])
                    at = e
                left.append(seq[at:])
                total.append(len(seq))
                removed.append(sum(e - b for b, e in found))
                kept.append(b" ".join(w for part in left for w in part) if words else b"".join(left))
                lists.append([{"begin": b, "end": e} for b, e in found])
                if offsets[r + 1] - offsets[begin] > 4_000_000 or r + 1 == batch.num_rows:
                    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begin, len(total)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, span), pa.array(kept, pa.binary()), carried.slice(begin, len(total))],
                        ["__id", "n_units", "n_removed", "spans", "kept", "__carry"],
                    )
                    total, removed, kept, lists = [], [], [], []
                    begin = r + 1

    schema = f"__id {id_type}, n_units long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary, __carry {rows.schema['__carry'].dataType.simpleString()}"
    return joined.mapInArrow(cut, schema).select(F.col("__id").alias(id_col), "n_units", "n_removed", "spans", "kept", *[F.col("__carry")[c].alias(c) for c in carry])
