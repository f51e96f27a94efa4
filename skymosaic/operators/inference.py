"""Models and network behind interfaces: detection by prompt, embedding, tile fetching, and what follows them.

A factory is called once for each task and gives the callable that does the work, so weights are loaded where they are
used. No model, decoder or network is part of this package.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quads
from ..functions.geometry import apply_affine

#: Bytes that a fetched tile must exceed: smaller ones are blank.
LEAST_BODY = 5_000


def prompt_name(index: Column, prompts: Sequence[str]) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, prompts)), F.when(index >= 0, index + 1).otherwise(len(prompts) + 1)), F.lit("unknown"))


def detect(tiles: DataFrame, prompts: Sequence[str], make: Callable[[], Callable[[bytes, str], list]], key: str = "tile_id", content: str = "content") -> DataFrame:
    """(key, label, conf, points) of every prompt on every tile; a tile is opened once for all prompts.

    The model's callable gives (ring, confidence or None) pairs; a missing confidence is 1, rings under 3 points go.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for k, picture in zip(frame[key], frame[content]):
                for p in prompts:
                    rows += [(k, p, 1.0 if conf is None else float(conf), [{"x": float(x), "y": float(y)} for x, y in ring]) for ring, conf in model(picture, p) if len(ring) >= 3]
            yield pd.DataFrame(rows, columns=[key, "label", "conf", "points"])

    return tiles.select(key, content).mapInPandas(work, f"`{key}` {tiles.schema[key].dataType.simpleString()}, label string, conf double, points array<struct<x:double,y:double>>")


def merge_sliced(detections: DataFrame, key: str = "source_id", label: str = "label", least: float = 0.5, size: float = 384.0) -> DataFrame:
    """Detections of overlapping slices without those that another one covers: `least` of the smaller area in common, same label.

    detections: key, det_id, label, conf, points (convex quadrilaterals in the coordinates of the whole picture). The more
    confident one stays, by det_id on ties, unless a better one already removed it.
    """
    from .gathered import uncovered_by_source

    found, large = uncovered_by_source(detections.withColumnRenamed(label, "label"), key, "label", least)
    found = found if large is None else found.unionByName(_merge_large(large, key, "label", least, size))
    return found.withColumnRenamed("label", label).select(*detections.columns)


def _merge_large(detections: DataFrame, key: str, label: str, least: float, size: float) -> DataFrame:
    """The same for sources that are too large for a task: by grid cells and rounds over written pairs."""
    from ..session import checkpointed
    from .spatial import polygon_pairs

    d = checkpointed(detections)
    a = d.select(key, F.col("det_id").alias("a"), F.col(label).alias("__label"), F.col("conf").alias("conf_a"), F.col("points").alias("truth_points"))
    b = d.select(key, F.col("det_id").alias("b"), F.col(label).alias("__other"), F.col("conf").alias("conf_b"), F.col("points").alias("pred_points"))
    pairs = polygon_pairs(a, b, key, size)
    better = (F.col("conf_a") > F.col("conf_b")) | ((F.col("conf_a") == F.col("conf_b")) & (F.col("a") < F.col("b")))
    size_a, size_b = quads.area(F.col("truth_points")), quads.area(F.col("pred_points"))
    common = F.col("iou") * (size_a + size_b) / (1 + F.col("iou"))
    left = pairs.filter((F.col("__label") == F.col("__other")) & better & (common >= least * F.least(size_a, size_b))).select(key, "a", "b")
    left, gone = checkpointed(left), None
    while True:  # those whose betters all stand or fall are settled; each round settles the best of every chain
        undecided = left.join(left.select(key, F.col("b").alias("a")).distinct(), [key, "a"], "left_semi").select(key, F.col("a")).distinct()
        lost = checkpointed(left.join(undecided, [key, "a"], "left_anti").select(key, F.col("b").alias("det_id")).distinct())
        if not lost.limit(1).count():
            break
        gone = lost if gone is None else gone.unionByName(lost)
        names = lost.select(key, "det_id")
        left = left.join(names.withColumnRenamed("det_id", "a"), [key, "a"], "left_anti").join(names.withColumnRenamed("det_id", "b"), [key, "b"], "left_anti").select(key, "a", "b")
        left = checkpointed(left)
    return d if gone is None else d.join(gone.distinct(), [key, "det_id"], "left_anti").select(*detections.columns)


def refine(detections: DataFrame, keep: Column | None = None) -> DataFrame:
    """Detections after a condition on shape, size or score; all of them without one."""
    return detections if keep is None else detections.filter(keep)


def georeference(detections: DataFrame, tiles: DataFrame, key: str = "tile_id", transform: str = "transform", offset: float = 0.0) -> DataFrame:
    """Points by their tile's affine transform (struct a..f); `offset` 0.5 for pixel centres."""
    joined = detections.join(tiles.select(key, F.col(transform).alias("__t")), key)
    return joined.withColumn("points", apply_affine(F.col("__t"), F.col("points"), offset)).drop("__t")


def embed(pictures: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], key: str, shape: Sequence[str] = ("height", "width", "bands"), samples: str = "samples", batch: int = 32) -> DataFrame:
    """(key, img_feature): pictures of one shape go to the model `batch` at a time; what fails has a null feature."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            frame = frame.reset_index(drop=True)
            out: list = [None] * len(frame)
            for size, group in frame.groupby(list(shape)):
                for i in range(0, len(group), batch):
                    part = group.iloc[i : i + batch]
                    try:
                        found = model(np.stack([prepare(np.asarray(s, float).reshape([int(n) for n in size])) for s in part[samples]]))
                        for at, f in zip(part.index, found):
                            out[at] = np.asarray(f, np.float32)
                    except ValueError:  # a picture that the model cannot take
                        continue
            yield pd.DataFrame({key: frame[key], "img_feature": out})

    return pictures.select(key, *shape, samples).mapInPandas(work, f"`{key}` {pictures.schema[key].dataType.simpleString()}, img_feature array<float>")


def prepare(x: np.ndarray) -> np.ndarray:
    """Three bands at most, bytes: wide samples by their 2nd and 98th percentiles, others by their maximum."""
    x = x[:, :, :3]
    top = x.max(initial=0)
    if top > 255:
        low, high = np.percentile(x, (2, 98))
        return (np.clip((x - low) / (high - low + 1e-6), 0, 1) * 255).astype(np.uint8)
    return x.astype(np.uint8) if top > 1 else (x / top * 255 if top > 0 else x).astype(np.uint8)


def kernel_weights(n: int, size: int, kind: str) -> np.ndarray:
    """size x n matrix that resamples a line of n samples; edges repeat."""
    reach = {"cubic": 2, "lanczos": 4}[kind]
    centre = (np.arange(size) + 0.5) * n / size - 0.5
    at = np.floor(centre).astype(int)[:, None] + np.arange(1 - reach, reach + 1)[None, :]
    d = np.abs(centre[:, None] - at)
    if kind == "cubic":
        a = -0.75
        w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
    else:
        w = np.where(d < reach, np.sinc(d) * np.sinc(d / reach), 0)
    w = w / w.sum(1, keepdims=True)
    out = np.zeros((size, n))
    np.add.at(out, (np.repeat(np.arange(size), at.shape[1]), np.clip(at, 0, n - 1).ravel()), w.ravel())
    return out


def resize(pictures: DataFrame, key: str, height: int, width: int, kind: str = "cubic") -> DataFrame:
    """(key, height, width, bands, samples) at another size; pictures that have it pass as they are."""
    schema = f"`{key}` {pictures.schema[key].dataType.simpleString()}, height int, width int, bands int, samples array<double>"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            rows = []
            for k, h, w, b, s in frame.itertuples(index=False):
                x = np.asarray(s, float).reshape(h, w, b)
                if (h, w) != (height, width):
                    for n, size in ((h, height), (w, width)):
                        if (n, size) not in known:
                            known[n, size] = kernel_weights(n, size, kind)
                    x = np.einsum("ij,jkb,lk->ilb", known[h, height], x, known[w, width], optimize=True)
                rows.append((k, height, width, b, x.ravel()))
            yield pd.DataFrame(rows, columns=[key, "height", "width", "bands", "samples"])

    return pictures.select(key, "height", "width", "bands", "samples").mapInPandas(work, schema)


class Pace:
    """Lets a task ask at most `rate` times a second, `total` tasks sharing the budget: the k-th one starts a k-th of a turn late.

    `clock` gives the time and `sleep` waits; no two of a task's requests are closer than total / rate seconds.
    """

    def __init__(self, rate: float, k: int, total: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = total / rate, clock, sleep
        self.next = clock() + (k % total) / rate

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = max(self.clock(), self.next)
        self.next = max(now, self.next) + self.gap


def asked(get: Callable, z: int, x: int, y: int, least: int, retries: int, pace: Pace | None, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes | None, str | None, int]:
    """(body, reason of failure, attempts) of one tile. What may pass (no answer, 429, 5xx) is asked again, `retries` times at most; each attempt counts in the budget."""
    reason = None
    for attempt in range(retries + 1):
        if attempt:
            sleep(backoff * 2 ** (attempt - 1))
        if pace:
            pace.wait()
        try:
            status, body = get(z, x, y)
        except OSError as e:  # time-outs are of this kind, too
            reason = f"{type(e).__name__}: {e}"
            continue
        if status == 200:
            return (body, None, attempt + 1) if len(body) > least else (None, "blank", attempt + 1)
        reason = f"status {status}"
        if status != 429 and status < 500:
            return None, reason, attempt + 1
    return None, reason, retries + 1


def fetch(tiles: DataFrame, make: Callable[[], Callable[[int, int, int], tuple[int, bytes]]], least: int = LEAST_BODY, rate: float | None = None, parts: int = 8, retries: int = 0, failures: bool = False) -> DataFrame:
    """(zoom, x, y, content) of the tiles that answer 200 with more than `least` bytes; failures are left out, or with `failures` kept with `error` and `attempts`.

    With `rate` all tasks together ask at most so many times a second: tiles are dealt to `parts` tasks, each with an equal
    share of the budget, whether or not all run at once. The time-out is the callable's own: it raises OSError. `make` is
    called once a task.
    """
    wanted = tiles.selectExpr("cast(zoom as int) zoom", "cast(x as long) x", "cast(y as long) y")
    wanted = wanted.repartition(parts) if rate else wanted
    if rate is not None and rate <= 0:
        raise ValueError("rate must be above 0")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make()
        context = TaskContext.get()
        pace = Pace(rate, context.partitionId() if context else 0, parts) if rate else None
        for frame in frames:
            rows = []
            for z, x, y in zip(frame["zoom"], frame["x"], frame["y"]):
                body, reason, attempts = asked(get, int(z), int(x), int(y), least, retries, pace)
                if failures or reason is None:
                    rows.append((z, x, y, body, reason, attempts)[: 6 if failures else 4])
            yield pd.DataFrame(rows, columns=["zoom", "x", "y", "content", "error", "attempts"][: 6 if failures else 4])

    return wanted.mapInPandas(work, "zoom int, x long, y long, content binary" + (", error string, attempts int" if failures else ""))
