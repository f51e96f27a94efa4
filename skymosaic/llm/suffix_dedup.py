"""Suffix-array dedup: byte strings that start earlier in the collection are removed.

Shards of runs that share an anchor (see `repeats`) are suffix-sorted together, column by column: each round puts one
more symbol in front of every string of the shard. The collection's Burrows-Wheeler transform gives the places of the new
suffixes (a symbol's rank among equal symbols), and the common prefix of each new suffix and its neighbours is one more
than the least of those between the neighbours of the round before. Transform, common prefixes and suffix names are
sequential arrays that every round reads once, in order, and writes anew. They are kept in memory instead of files: a shard
is bounded (256 KB of text), local folders of a machine are no place for a cluster's data, and a file a round in the shared
folder would cost far more than the round. What does not fit a task goes through Spark's shuffle files. Suffixes whose
common prefixes reach `width` hold one string; all but the earliest are removed. A passage that several documents hold
enters a shard once: its later owners lose it whole, as the same bytes stand at an earlier place. Window hashes only choose
which parts of passages are sorted; they never remove anything.

Cases: null and empty texts have no bytes; texts shorter than the window keep everything; matches never cross documents;
equal rows are at the same place and keep each other's bytes; a null id counts as the largest; an empty table gives an
empty table; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram, mix
from .repeats import BYTE_HASH, Plan, later, remove

WIDTH, GRAM = 100, 32


def sort_columns(strings: list[bytes], most: int = 30_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one before, `most` at most) of all suffixes in order, ends included.

    UTF-8 has no byte 255, so a byte plus one fits its type and 0 stands for a string's end.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    start = np.append(0, np.cumsum(size))[:-1]
    data = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    bwt = np.zeros(m, np.uint8)
    some = size > 0
    bwt[some] = data[(start + size - 1)[some]]
    common = np.zeros(m, np.int16)
    serial = np.arange(m, dtype=np.int32)  # of suffixes, in the order of their insertion
    names, offsets = [np.arange(m)], [size]
    inserted = m
    place = np.arange(m)  # of each string's longest suffix so far
    for j in range(1, int(size.max(initial=0)) + 1):
        active = np.flatnonzero(size >= j)
        active = active[np.argsort(place[active])]
        p = place[active]
        order = np.argsort(bwt, kind="stable").astype(np.int32)
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        ended = len(bwt) - np.count_nonzero(bwt)
        r = rank[p]
        new = m + r - ended
        padded = np.append(common, np.int16(0))
        symbol = bwt[p]

        def between(low: np.ndarray, high: np.ndarray, same: np.ndarray) -> np.ndarray:
            """One more than the least common prefix of places low+1..high; 0 where the symbols differ."""
            out = np.zeros(len(low), np.int16)
            if same.any():
                edges = np.stack([low[same] + 1, high[same] + 1], 1).ravel()
                out[same] = np.minimum(np.minimum.reduceat(padded, edges)[::2] + 1, most)  # noqa: B023
            return out

        before = order[np.maximum(r - 1, 0)]
        with_before = between(before, p, (r > 0) & (bwt[before] == symbol))
        after = order[np.minimum(r + 1, len(order) - 1)]
        with_after = between(p, after, (r + 1 < len(order)) & (bwt[after] == symbol))
        n = len(bwt) + len(active)
        old = np.ones(n, bool)
        old[new] = False
        kept = np.flatnonzero(old)
        grown = [np.empty(n, x.dtype) for x in (bwt, common, serial)]
        for g, x in zip(grown, (bwt, common, serial)):
            g[kept] = x
        at = size[active] - j
        grown[0][new] = np.where(at > 0, data[np.maximum(start[active] + at - 1, 0)], 0)
        follows = new + 1 < n
        grown[1][new[follows] + 1] = with_after[follows]
        grown[1][new] = with_before
        grown[2][new] = inserted + np.arange(len(active))
        inserted += len(active)
        names.append(active), offsets.append(at)
        bwt, common, serial = grown
        place[active] = new
    return np.concatenate(names)[serial], np.concatenate(offsets)[serial], common


def shared_parts(passages: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, begin, end) of the parts, from the first to the last window whose hash occurs twice; different hashes mean different strings."""
    data = np.frombuffer(b"".join(passages), np.uint8)
    ends = np.cumsum([len(p) for p in passages])
    owner = np.repeat(np.arange(len(passages)), np.diff(ends, prepend=0))
    at = np.flatnonzero(np.arange(len(data)) + width <= ends[owner])
    window = mix(gram(BYTE_HASH[data], width))[at]
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    name = owner[at]
    fresh = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
    last = np.append(fresh[1:], len(name)) - 1
    begin = ends[name[fresh]] - np.array([len(passages[i]) for i in name[fresh]], np.int64)
    return name[fresh], at[fresh] - begin, at[last[: len(fresh)]] - begin + width


def covered(passages: list[bytes], which: np.ndarray, docs: np.ndarray, starts: np.ndarray, width: int):
    """(owner, first window, last window) of strings of `width` bytes that start earlier; owner r holds passage which[r].

    A passage's later owners hold it at a later place than its first ones, so all of its windows go there. What first owners
    hold is told by the suffix order of the parts of different passages that may be equal.
    """
    order = np.lexsort((starts, docs, which))
    after = np.empty(len(which), bool)
    after[order] = later(docs[order], starts[order], which[order], True)
    fresh = np.append(True, which[order][1:] != which[order][:-1])
    first = order[fresh]  # of each passage
    size = np.array([len(p) for p in passages], np.int64)
    whole = np.flatnonzero(after)
    found = [(whole, np.zeros(len(whole), np.int64), size[which[whole]] - width)]
    part, begin, end = shared_parts(passages, width)
    if len(part):
        name, offset, common = sort_columns([passages[i][a:b] for i, a, b in zip(part.tolist(), begin.tolist(), end.tolist())], width)
        group = np.cumsum(common < width)
        inside = np.flatnonzero((np.append(common[1:], 0) >= width) | (common >= width))
        group, offset, name = group[inside], offset[inside] + begin[name[inside]], part[name[inside]]
        doc, place = docs[first[name]], starts[first[name]] + offset
        order = np.lexsort((place, doc, group))
        gone = order[later(doc[order], place[order], group[order], True)]
        # consecutive windows of a passage become one span, for each of its first owners
        gone = gone[np.lexsort((offset[gone], name[gone]))]
        n, o = name[gone], offset[gone]
        at = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (o[1:] != o[:-1] + 1))[: len(n)])
        n, a, b = n[at], o[at], o[np.append(at[1:], len(o))[: len(at)] - 1]
        owners = np.flatnonzero(~after)
        owners = owners[np.argsort(which[owners], kind="stable")]
        low, high = np.searchsorted(which[owners], n), np.searchsorted(which[owners], n, "right")
        each = np.repeat(np.arange(len(n)), high - low)
        step = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        found.append((owners[low[each] + step], a[each], b[each]))
    return tuple(np.concatenate(x) for x in zip(*found))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = 1_000, carry: Sequence[str] = ()) -> DataFrame:
    """See `repeats.remove`; units are bytes."""
    return remove(docs, Plan(width, gram, False, True, covered, hot), id_col, text_col, carry)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
