"""Media columns: lossless PNG storage of payloads, checked decoding, and low-frequency cosine-transform hashes.

`encode_png` writes 8-bit grey samples, a row of `width` bytes after another, with the row filter that leaves the least
absolute residue; `decode_png` walks the chunks, tests the signature, every chunk's CRC-32 and zlib's checksum, and undoes
all five row filters with numpy. `frequency_hash` averages the picture down to 32 x 32, takes the 8 x 8 lowest
frequencies of its two-dimensional cosine transform and sets a bit for each above their median.

Cases: a null text is the empty text, whose payload is 64 zero bytes; texts of any length are stored whole; equal texts
give equal values, ties at the median give 0 bits; repeated rows are repeated; an empty table gives an empty table; other
columns are not read. A damaged picture raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_view

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
BATCH_BYTES = 4_000_000


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: np.ndarray, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey PNG of `payload`, whose length is a positive multiple of `width`."""
    image = payload.reshape(-1, width)
    sub = image.copy()
    sub[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    choices = np.stack([image, sub, up])
    cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    rows = np.empty((len(image), width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = choices[best, np.arange(len(image))]
    header = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _average_row(row: np.ndarray, above: np.ndarray) -> None:
    left = 0
    for x in range(len(row)):
        left = row[x] = (int(row[x]) + (left + int(above[x])) // 2) & 255


def _paeth_row(row: np.ndarray, above: np.ndarray) -> None:
    left = corner = 0
    for x in range(len(row)):
        b = int(above[x])
        p = left + b - corner
        near = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
        left, corner = (int(row[x]) + near) & 255, b
        row[x] = left


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, not interlaced PNG as rows."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(content) != size or zlib.crc32(content, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey picture")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"compressed samples are damaged: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    kind, image = rows[:, 0], rows[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown row filter")
    sub = kind == 1
    image[sub] = np.cumsum(image[sub], axis=1, dtype=np.uint8)
    # Rows that need the row above come in runs; a run of "up" rows is one cumulative sum.
    edges = np.flatnonzero(np.diff(kind, prepend=255))
    for first, last in zip(edges, np.append(edges[1:], height)):
        if kind[first] == 2:
            start = max(first - 1, 0)
            image[start:last] = np.cumsum(image[start:last], axis=0, dtype=np.uint8)
        elif kind[first] > 2:
            undo = _average_row if kind[first] == 3 else _paeth_row
            for y in range(first, last):
                undo(image[y], image[y - 1] if y else np.zeros(width, np.uint8))
    return image


_n = np.arange(32)
_COS = np.cos(np.pi * (2 * _n[None, :] + 1) * np.arange(8)[:, None] / 64)


def _shrink(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 line of the 32 bands that n lines fall into."""
    first = np.arange(32) * n // 32
    return first, np.maximum((np.arange(32) + 1) * n // 32, first + 1)


def frequency_hash(image: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0, dtype=np.int64).cumsum(1)
    (y0, y1), (x0, x1) = _shrink(image.shape[0]), _shrink(image.shape[1])
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    small = (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / area
    low = np.round(_COS @ small @ _COS.T, 6)
    rest = low.ravel()[1:]
    return np.packbits(low.ravel() > np.median(rest)).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """`id_col`, `n_bytes`, `media` (PNG of the padded UTF-8 bytes) of every text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            begin, media = 0, []
            for i in range(batch.num_rows):
                size = int(offsets[i + 1] - offsets[i])
                payload = np.zeros(max(width, -(-size // width) * width), np.uint8)
                payload[:size] = data[offsets[i] : offsets[i + 1]]
                media.append(encode_png(payload, width))
                if offsets[i + 1] - offsets[begin] >= BATCH_BYTES or i + 1 == batch.num_rows:
                    sizes = pa.array(np.diff(offsets[begin : i + 2]), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(media)), sizes, pa.array(media, pa.binary())], schema.names)
                    begin, media = i + 1, []

    return rows.mapInArrow(work, schema)


def read_back(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of `stored`, and `payload` (the samples read back) and `feature` (their frequency hash)."""
    ship(stored.sparkSession)
    schema = T.StructType([*stored.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])
    place = stored.columns.index(media_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                images = [decode_png(x.as_py()) if x.is_valid else None for x in part.column(place)]
                payloads = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
                features = pa.array([None if x is None else frequency_hash(x) for x in images], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, payloads, features], schema.names)

    return stored.mapInArrow(work, schema)


def digest(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return read.select(
        id_col, "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
