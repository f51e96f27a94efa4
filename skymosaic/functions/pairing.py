"""Rings of whole sources inside a task: which meet, what they share, and who takes whom, on arrays.

Rows lie in chunks of whole sources. Candidates are found by sorting, not by cells, so a box costs the same whatever its size;
they are worked in slices of a bounded number of pairs, in the order in which choosers choose, so what is held does not grow
with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import areas, convex_quads, shared, simple
from .repair import repaired

#: Rows from which a chunk is worked, candidate pairs of a slice, and pairs that are cut at a time.
ROWS, PAIRS, CUT = 16_384, 2_000_000, 32_768


def whole_sources(batches: Iterator[pa.RecordBatch], least: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of whole sources of rows sorted by their first column; rows of null keys, which come first, are not held."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        missing = batch.column(0).null_count
        if missing:
            yield batch.slice(0, missing)
            batch = batch.slice(missing)
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            all_rows = _together(held)
            key = all_rows.column(0)
            begun = int(np.argmax(pc.equal(key, key[-1]).to_numpy(zero_copy_only=False)))
            if begun:
                yield all_rows.slice(0, begun)
            held, rows = [all_rows.slice(begun)], all_rows.num_rows - begun
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sources(key: pa.Array) -> np.ndarray:
    """Codes of a chunk's keys; rows of one key must lie together."""
    out = codes(key)
    if (np.diff(out) < 0).any():
        raise ValueError("rows are not sorted by their key")
    return out


def codes(values: pa.Array) -> np.ndarray:
    """A number for each distinct value, in the order in which they come; -1 for null."""
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def ranks(values: pa.Array) -> np.ndarray:
    """Places of values in their order, equal ones share one; null comes last."""
    return pc.rank(values, tiebreaker="dense").to_numpy().astype(np.int64)


class Rings:
    """Rings as flat coordinates; `row` tells which row of the chunk each is of."""

    def __init__(self, row: np.ndarray, first: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.row, self.n = row, n
        at = np.repeat(first, n) + _steps(n)
        self.x, self.y = x[at], y[at]
        self.first = np.cumsum(n) - n
        low = lambda c: np.minimum.reduceat(c, self.first) if len(n) else c[:0]
        high = lambda c: np.maximum.reduceat(c, self.first) if len(n) else c[:0]
        self.box = (low(self.x), low(self.y), high(self.x), high(self.y))
        self.area = np.zeros(len(n))
        for k, x, y in self.by_size(np.arange(len(n))):
            self.area[k] = areas(x, y)

    @classmethod
    def of(cls, flat: pa.Array, wanted: np.ndarray) -> Rings:
        """Rings of the wanted rows from arrays x, y, x, y, ...; those with nulls, without finite numbers or of less than three points are left out."""
        offsets = flat.offsets.to_numpy()
        values = flat.values.to_numpy(zero_copy_only=False)
        n = np.diff(offsets)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        ok = wanted & flat.is_valid().to_numpy(zero_copy_only=False) & (n >= 6) & (bad[offsets[1:]] == bad[offsets[:-1]])
        row = np.flatnonzero(ok)
        return cls(row, offsets[:-1][row] // 2, n[row] // 2, *_pairs(values))

    def by_size(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in `which`, x and y) for each number of corners."""
        sizes = self.n[which]
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            yield at, *self.corners(which[at], int(n))

    def corners(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = self.first[which][:, None] + np.arange(n)
        return self.x[p], self.y[p]


def _pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    even = values[: len(values) // 2 * 2]
    return even[0::2], even[1::2]


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the numbers."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def signed_pieces(rings: Rings, rule: str) -> tuple[Rings, np.ndarray]:
    """Valid rings as they are, others as what a repair leaves of them; and 1 for what counts as area, -1 for a hole."""
    valid = np.zeros(len(rings.n), bool)
    row, sign, xs, ys = [], [], [], []
    for at, x, y in rings.by_size(np.arange(len(rings.n))):
        valid[at] = good = simple(x, y)
        bad = at[~good]
        for k in bad[~_crossed_once(rings, bad, x[~good], y[~good], row, sign, xs, ys)]:
            points = slice(rings.first[k], rings.first[k] + rings.n[k])
            for ring in repaired(list(zip(rings.x[points].tolist(), rings.y[points].tolist())), rule):
                x1, y1 = np.array(ring).T
                row.append([rings.row[k]])
                xs.append(x1[None])
                ys.append(y1[None])
                sign.append([np.sign((x1 * np.roll(y1, -1) - np.roll(x1, -1) * y1).sum())])
    keep = np.flatnonzero(valid)
    n = np.concatenate([rings.n[keep], *[np.full(len(x), x.shape[1]) for x in xs]]).astype(np.int64)
    at = np.repeat(rings.first[keep], rings.n[keep]) + _steps(rings.n[keep])
    flat = [np.concatenate([c[at], *[v.ravel() for v in more]]) for c, more in ((rings.x, xs), (rings.y, ys))]
    rows = np.concatenate([rings.row[keep], *row]).astype(np.int64)
    return Rings(rows, np.cumsum(n) - n, n, *flat), np.concatenate([np.ones(len(keep)), *sign])


def _crossed_once(rings: Rings, at: np.ndarray, x: np.ndarray, y: np.ndarray, row: list, sign: list, xs: list, ys: list) -> np.ndarray:
    """Which rings are four corners of which two opposite sides cross well inside: they are two triangles, which are added. Others are not told."""
    done = np.zeros(len(at), bool)
    if x.shape[1] != 4:
        return done
    z = x + 1j * y
    origin = z.mean(1, keepdims=True)
    z = z - origin
    extent = np.maximum(np.ptp(z.real, axis=1), np.ptp(z.imag, axis=1))
    sides = np.abs(np.roll(z, -1, 1) - z)
    long = (sides > 1e-6 * extent[:, None]).all(1) & (extent > 0)
    for a, faces in ((0, ((-1, 1, 2), (0, -1, 3))), (1, ((0, 1, -1), (-1, 2, 3)))):
        p, d, q, e = z[:, a], z[:, a + 1] - z[:, a], z[:, a + 2], z[:, (a + 3) % 4] - z[:, a + 2]
        cross, away = d.real * e.imag - d.imag * e.real, q - p
        with np.errstate(all="ignore"):
            t, u = (away.real * e.imag - away.imag * e.real) / cross, (away.real * d.imag - away.imag * d.real) / cross
        hit = long & (np.abs(cross) > 1e-9 * np.abs(d) * np.abs(e)) & (np.minimum(t, u) > 1e-6) & (np.maximum(t, u) < 1 - 1e-6) & ~done
        k = np.flatnonzero(hit)
        if not len(k):
            continue
        middle = p[k] + d[k] * t[k]
        for face in faces:
            c = np.stack([middle if i < 0 else z[k, i] for i in face], 1) + origin[k]
            xs.append(c.real)
            ys.append(c.imag)
            row.append(rings.row[at[k]])
            sign.append(np.ones(len(k)))
        done |= hit
    return done


def _places(source: np.ndarray, value: np.ndarray, asked: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
    """How many of the rows (source, value) lie before each asked (source, limit), or up to it with `after`."""
    mine = np.concatenate([np.zeros(len(source), bool), np.ones(len(asked), bool)])
    order = np.lexsort((mine == (not after), np.concatenate([value, limit]), np.concatenate([source, asked])))
    out = np.empty(len(mine), np.int64)
    out[order] = np.cumsum(~mine[order])
    return out[len(source) :]


def meeting(a_source: np.ndarray, a_turn: np.ndarray, a_box: tuple, b_source: np.ndarray, b_box: tuple, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of boxes of one source that meet, in slices of rising turns of a; a turn lies in one slice.

    Boxes of b of about one width are sorted by their left edge, and each of a looks up those that can reach it.
    """
    spans = []
    width = b_box[2] - b_box[0]
    kind = np.frexp(width)[1]
    kind = np.maximum(kind, kind.max(initial=0) - 24)
    for k in np.unique(kind):
        these = np.flatnonzero(kind == k)
        widest = width[these].max()
        these = these[np.lexsort((b_box[0][these], b_source[these]))]
        slack = (np.abs(a_box[0]) + widest) * 1e-12
        low = _places(b_source[these], b_box[0][these], a_source, a_box[0] - widest - slack, False)
        high = _places(b_source[these], b_box[0][these], a_source, a_box[2], True)
        spans.append((these, low, np.maximum(high - low, 0)))
    if not spans:
        return
    order = np.argsort(a_turn, kind="stable")
    load = np.cumsum(sum(n for _, _, n in spans)[order])
    turn = a_turn[order]
    ends = np.flatnonzero(np.append(turn[1:] != turn[:-1], True)) + 1  # where a slice may end
    begin = 0
    while begin < len(order):
        before = load[begin - 1] if begin else 0
        full = np.searchsorted(load, before + most, "right")
        end = int(ends[min(max(np.searchsorted(ends, full, "right") - 1, np.searchsorted(ends, begin, "right")), len(ends) - 1)])
        part = order[begin:end]
        found = []
        for these, low, n in spans:
            i = np.repeat(part, n[part])
            j = these[np.repeat(low[part], n[part]) + _steps(n[part])]
            met = (a_box[1][i] <= b_box[3][j]) & (b_box[1][j] <= a_box[3][i]) & (a_box[0][i] <= b_box[2][j])
            found.append((i[met], j[met]))
        yield np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])
        begin = end


def could_share(a: Rings, b: Rings, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether what pairs' boxes share reaches `least`, which areas are held against; with room for the rounding of areas."""
    wide = np.minimum(a.box[2][i], b.box[2][j]) - np.maximum(a.box[0][i], b.box[0][j])
    high = np.minimum(a.box[3][i], b.box[3][j]) - np.maximum(a.box[1][i], b.box[1][j])
    far = max((np.abs(c).max(initial=0.0) for r in (a, b) for c in r.box), default=0.0)
    return np.maximum(wide, 0) * np.maximum(high, 0) >= least * (1 - 1e-9) - 256 * np.finfo(float).eps * far * far


def common_areas(a: Rings, b: Rings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Area that rings of each pair share."""
    out = np.zeros(len(i))
    size = a.n[i] * (b.n.max(initial=0) + 1) + b.n[j]
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        for begin in range(0, len(at), CUT):
            p = at[begin : begin + CUT]
            out[p] = shared(*a.corners(i[p], int(a.n[i[p[0]]])), *b.corners(j[p], int(b.n[j[p[0]]])))
    return out


def overlaps(a: Rings, sign: np.ndarray | None, b: Rings, i: np.ndarray, j: np.ndarray, full: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, place in b, IoU) of pairs that reach `least`. `full` is a row's whole area; with `sign` a row may have many rings."""
    whole = full[a.row[i]] + b.area[j]
    if sign is None:
        near = could_share(a, b, i, j, least / (1 + least) * whole)
        i, j, whole = i[near], j[near], whole[near]
        rows, common = a.row[i], common_areas(a, b, i, j)
        union = whole - common
        with np.errstate(all="ignore"):
            iou = np.where(union > 0, np.minimum(1.0, common / union), 0.0)
    else:
        pair, first, back = np.unique(a.row[i] * (len(b.n) + 1) + j, return_index=True, return_inverse=True)
        common = np.bincount(back.ravel(), sign[i] * common_areas(a, b, i, j), len(pair))
        rows, j, whole = a.row[i[first]], j[first], whole[first]
        union = whole - common
        with np.errstate(all="ignore"):
            iou = np.where(union > 0, np.minimum(1.0, np.maximum(0.0, common / union)), 0.0)
    kept = iou >= least
    return rows[kept], j[kept], iou[kept]


class InTurn:
    """In each group choosers take, in the order of their turns, the best that is free: the greatest IoU, then the least chosen."""

    def __init__(self):
        self.served: set = set()
        self.taken: set = set()

    def choose(self, group: np.ndarray, turn: np.ndarray, chosen: np.ndarray, iou: np.ndarray, last: bool) -> np.ndarray:
        """Places of the pairs that are taken. Calls come in rising turns; `last` if none follows."""
        if not len(group):
            return np.zeros(0, np.int64)
        order = np.lexsort((chosen, -iou, turn, group))
        one, other = group[order] * (turn.max() + 1) + turn[order], group[order] * (chosen.max() + 1) + chosen[order]
        alone = np.zeros(len(order), bool)
        if last and not self.taken:
            single = lambda v: (lambda u, back, n: n[back.ravel()] == 1)(*np.unique(v, return_inverse=True, return_counts=True))
            alone = single(one) & single(other)
        rest = np.flatnonzero(~alone)
        picked = []
        for k, g, t, c in zip(rest.tolist(), group[order[rest]].tolist(), turn[order[rest]].tolist(), chosen[order[rest]].tolist()):
            if (g, t) not in self.served and (g, c) not in self.taken:
                self.served.add((g, t))
                self.taken.add((g, c))
                picked.append(k)
        return order[np.concatenate([np.flatnonzero(alone), np.array(picked, np.int64)])]


def matches(key: np.ndarray, is_truth: np.ndarray, name: np.ndarray, label: np.ndarray | None, flat: pa.Array, least: float, rule: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a truth, row of a prediction, IoU) of the pairs that are matched in a chunk; -1 marks null keys, names and labels."""
    known = (key >= 0) & (name >= 0)
    truth = Rings.of(flat, known & is_truth)
    preds = Rings.of(flat, known & ~is_truth & (label >= 0 if label is not None else True))
    sign = None
    if rule:
        truth, sign = signed_pieces(truth, rule)
    full = np.bincount(truth.row, truth.area * (sign if sign is not None else 1.0), len(key))
    labels = int(label.max(initial=0)) + 1 if label is not None else 1
    out, waiting, turns = [], None, InTurn()

    def take(found: tuple, last: bool) -> None:
        rows, j, iou = found
        other = preds.row[j]
        group = key[rows] * labels + (label[other] if label is not None else 0)
        at = turns.choose(group, name[rows], name[other], iou, last)
        out.append((rows[at], other[at], iou[at]))

    for i, j in meeting(key[truth.row], name[truth.row], truth.box, key[preds.row], preds.box):
        if waiting:
            take(waiting, False)
        waiting = overlaps(truth, sign, preds, i, j, full, least)
    if waiting:
        take(waiting, True)
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, float)))


def covered(key: np.ndarray, label: np.ndarray, turn: np.ndarray, wanted: np.ndarray, flat: pa.Array, least: float) -> np.ndarray:
    """Rows that go: in the order of `turn`, what is still there removes what comes later, has its label and shares `least` of the smaller area with it."""
    rings = Rings.of(flat, wanted & (key >= 0) & (label >= 0))
    gone = np.zeros(len(key), bool)
    source = key[rings.row] * (int(label.max(initial=0)) + 1) + label[rings.row]  # only equal labels meet
    mine = turn[rings.row]
    for i, j in meeting(source, mine, rings.box, source, rings.box):
        later = mine[i] < mine[j]
        i, j = i[later], j[later]
        smaller = least * np.minimum(rings.area[i], rings.area[j])
        near = could_share(rings, rings, i, j, smaller)
        i, j, smaller = i[near], j[near], smaller[near]
        whole, common = rings.area[i] + rings.area[j], common_areas(rings, rings, i, j)
        with np.errstate(all="ignore"):
            iou = np.where(whole - common > 0, np.minimum(1.0, common / (whole - common)), 0.0)
        held = iou * whole / (1 + iou) >= smaller
        i, j = i[held], j[held]
        order = np.argsort(mine[i], kind="stable")
        for a, b in zip(rings.row[i[order]].tolist(), rings.row[j[order]].tolist()):
            if not gone[a]:
                gone[b] = True
    return gone


def falling(values: pa.Array) -> np.ndarray:
    """Ranks of numbers from the greatest on, as Spark orders them: NaN is above all others. Nulls are told apart elsewhere."""
    v = values.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    order = np.unique(np.where(np.isnan(v), np.inf, v), return_inverse=True)[1].ravel() + np.isnan(v)
    return order.max(initial=0) - order
