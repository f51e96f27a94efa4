"""What the corpus operators share: code shipping, written intermediate tables, and numpy views of Arrow text."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units (bytes or words) handled by one vectorised step; a document longer than this is a step of its own.
CHUNK = 1 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_skymosaic_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(), "skymosaic.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    context._skymosaic_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local one serves, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "skymosaic-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here and lost executors cost nothing.

    Results are lazy, so the files live as long as the application: its folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/skymosaic/{context.applicationId}"
    if getattr(context, "_skymosaic_folder", None) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._skymosaic_folder = folder
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of a key written as text, modulo `modulus`; a null key counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str, within: str | None = None, rows: int = 200_000) -> DataFrame:
    """Stored rows of `df`, with `part` (of about `rows` rows, in order), `place` (0, 1, ... in `order`) and `total`, both within equal `within`.

    `df` is a stored table, so that sampling its order is cheap. Rows that tie keep the order in which they are stored, so
    any number of equal rows is spread. Only a row for each part and value of `within` is counted and summed; no window
    goes over the rows themselves.
    """
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    count = df.count()
    n = max(min(partitions(df.sparkSession), count // 1000 + 1), -(-count // rows))
    order = [*([F.col(within)] if within else []), *order, F.col("__row")]
    sorted_ = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__row").withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(sorted_.withColumn("part", F.shiftright("__at", 33).cast("int")), name)
    keys = [within, "part"] if within else ["part"]
    counts = ranged.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys[:-1])
    counts = counts.withColumns({"total": F.sum("__n").over(whole), "__before": F.sum("__n").over(whole.orderBy("part")) - F.col("__n")}).drop("__n")
    return ranged.join(counts, keys).withColumn("place", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__first", "__before")


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """(first, last) document of consecutive groups of at most `limit` units, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Random numbers of the bytes at a word's first 64 places.
_PLACED = mix(np.arange(64 * 256, dtype=np.uint64) * _STEP + _STEP)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of a run of documents: places, owners and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, space: np.ndarray = _SPACE):
        """`space` tells of each byte (lower-cased first, if asked for) whether it parts words."""
        base = offsets[0]
        data = data[base : offsets[-1]]
        self.data = data = _LOWER[data] if lower else data
        self.doc_offsets = offsets - base
        space = space[data]
        opens = ~space
        after = opens.copy()
        after[1:] &= space[:-1]
        inner = self.doc_offsets[1:-1]
        inner = inner[inner < len(data)]
        after[inner] = opens[inner]  # a document starts a word of its own
        self.start = np.flatnonzero(after)
        ends = opens.copy()
        ends[:-1] &= space[1:]
        ends[inner[inner > 0] - 1] = opens[inner[inner > 0] - 1]
        self.end = np.flatnonzero(ends) + 1
        #: place of each document's first word, and one past the last
        self.bounds = np.searchsorted(self.start, self.doc_offsets)
        self.hash = self._hash(space) if hashes else None

    def _hash(self, space: np.ndarray) -> np.ndarray:
        """Each byte at each place has a random number of its own; a word's hash is their sum, scrambled."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = np.diff(np.append(self.start, len(self.data)))
        place = np.arange(self.start[0], len(self.data)) - np.repeat(self.start, length)
        at = place * 256 + self.data[self.start[0] :]
        near = int(length.max()) * 256 <= len(_PLACED)
        values = _PLACED[at] if near else np.where(at < len(_PLACED), _PLACED[np.minimum(at, len(_PLACED) - 1)], mix(at.astype(np.uint64) * _STEP + _STEP))
        values[space[self.start[0] :]] = 0
        return mix(np.add.reduceat(values, self.start - self.start[0]) + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def gram(h: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the `size` values from each place on (wrapping at the array's end), by doubling."""
    out, power, width, total, done = None, np.uint64(1), 1, h, 0
    b = np.uint64(base)
    block, step = h.copy(), b
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                shifted = np.roll(block, -done) if done else block
                out = shifted.copy() if out is None else out + shifted * power
                power = power * step
                done += width
            if done == size:
                return out
            block = block + np.roll(block, -width) * step
            step = step * step
            width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each place on; the last width-1 results are of fewer values."""
    block, w = x.copy(), 1
    while 2 * w <= width:
        block[:-w] = np.minimum(block[:-w], block[w:])
        w *= 2
    rest = width - w
    if rest:
        out = block.copy()
        out[:-rest] = np.minimum(block[:-rest], block[rest:])
        return out
    return block
