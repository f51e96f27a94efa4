"""Pictures with places: headers, windows and tile grids of TIFF files, and tiles written as PNG or TIFF.

Files are read by byte ranges where the windows are wanted: a task opens a file, reads its header and fetches the strips or
tiles of the format that its windows meet, so what is read grows with what is asked for, not with the files. `register` makes
two data sources known: `raster_tiles`, the grid of windows over all files of a folder, into which filters on the file's
stem and the window's place are pushed, and `tile_files`, which writes tiles as files that appear together or not at all. What
a file lacks or hides is told in its row's `error`. Kinds of files: see `tiff`.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .files import Ranges, located
from .tables import stem
from .tiff import Picture, header_of, tiff_bytes, window_of

__all__ = ["encoded_tiles", "header_of", "png_bytes", "read_headers", "read_tiles", "read_windows", "register", "tiff_bytes", "tile_name", "window_of", "write_tiles"]

HEADER = "width int, height int, bands int, epsg int, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>"
WINDOW = "stem string, x_off long, y_off long, height int, width int, bands int, samples array<double>, fetched long, error string"
FAULTS = (ValueError, KeyError, IndexError, struct.error, OSError)
#: Windows of a file that one task reads, in rows of windows that lie together.
GROUP = 64


def png_bytes(x: np.ndarray) -> bytes:
    """A PNG of rows x columns x 1 or 3 bands of bytes."""
    h, w, bands = x.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.hstack([np.zeros((h, 1), np.uint8), np.ascontiguousarray(x, np.uint8).reshape(h, -1)])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[bands], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, stem) of files; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", stem(F.col("path")).alias("stem"))


def read_headers(spark: SparkSession, path: str, glob: str = "*.[tT][iI][fF]*") -> DataFrame:
    """(stem, width, height, bands, epsg, transform, error) of each file; no pixel is read."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for place, name in zip(frame["path"], frame["stem"]):
                try:
                    source = Ranges(place)
                    rows.append({"stem": name, **header_of(source), "error": None})
                    source.close()
                except FAULTS as e:  # the file's fault: told in its row
                    rows.append({"stem": name, "width": None, "height": None, "bands": None, "epsg": None, "transform": None, "error": str(e)})
            yield pd.DataFrame(rows).astype({c: "Int32" for c in ("width", "height", "bands", "epsg")})

    return _listed(spark, path, glob).mapInPandas(work, f"stem string, {HEADER}, error string")


def _windows(path: str, name: str, wanted: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
    """Rows of WINDOW for windows (x, y, w, h) of one file, from the top down; blocks are kept for a row of windows."""
    source = picture = None
    fault = None
    try:
        source = Ranges(path)
        picture = Picture(source)
    except FAULTS as e:
        fault = str(e)
    blocks: dict = {}
    row = None
    for x, y, w, h in sorted(wanted, key=lambda v: (v[1], v[0])):
        if picture is None:
            yield (name, x, y, None, None, None, None, source.fetched if source else 0, fault)
            continue
        if y != row:
            blocks = {k: v for k, v in blocks.items() if (k[1] + 1) * picture.block_h > y}
            row = y
        before = source.fetched
        try:
            found = picture.window(x, y, w, h, blocks)
            yield (name, x, y, *found.shape, found.astype(float).ravel(), source.fetched - before, None)
        except FAULTS as e:
            yield (name, x, y, None, None, None, None, source.fetched - before, str(e))
    if source:
        source.close()


def read_windows(spark: SparkSession, path: str, windows: DataFrame, glob: str = "*.[tT][iI][fF]*", group: int = GROUP) -> DataFrame:
    """WINDOW rows of the windows (stem, x_off, y_off, w, h) asked for; `fetched` counts the bytes that a window made the task read.

    Windows go to tasks by file and by bands of 4,096 rows of pixels, `group` at most for each opening of the file.
    """
    band = F.floor(F.col("y_off") / 4096)
    asked = windows.join(_listed(spark, path, glob), "stem").withColumn("band", band)
    asked = asked.select("path", "stem", "band", F.struct("y_off", "x_off", "w", "h").alias("v")).repartition("path", "band").sortWithinPartitions("path", "band", "v")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in WINDOW.split(", ")]
        for frame in frames:
            for (place, name, _), mine in frame.groupby(["path", "stem", "band"], sort=False):
                views = [(int(v["x_off"]), int(v["y_off"]), int(v["w"]), int(v["h"])) for v in mine["v"]]
                for k in range(0, len(views), group):
                    rows = list(_windows(place, name, views[k : k + group]))
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("height", "width", "bands")})

    return asked.mapInPandas(work, WINDOW)


@dataclass
class Rows(D.InputPartition):
    """Some rows of windows of one file: the k-th of n groups."""

    path: str
    name: str
    k: int
    n: int


class TilesReader(D.DataSourceReader):
    """Windows of `tile` pixels every `stride` pixels over each file of a folder; a partition holds some rows of windows of one file."""

    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", r".*\.[tT][iI][fF]+")
        self.tile = int(options.get("tile", 768))
        self.stride, self.groups = int(options.get("stride", self.tile)), int(options.get("groups", 8))
        if min(self.tile, self.stride, self.groups) < 1:
            raise ValueError("tile, stride and groups must be 1 at least")
        self.stems: set | None = None
        self.low = {"x_off": None, "y_off": None}
        self.high = {"x_off": None, "y_off": None}

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality and lists of stems, and comparisons of places; Spark applies all others itself."""
        for f in filters:
            name = ".".join(f.attribute) if getattr(f, "attribute", None) else None
            if isinstance(f, (D.EqualTo, D.In)) and name == "stem":
                chosen = {f.value} if isinstance(f, D.EqualTo) else set(f.value)
                self.stems = chosen if self.stems is None else self.stems & chosen
            elif name in self.low and isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)):
                strict = isinstance(f, (D.GreaterThan, D.LessThan))
                if not isinstance(f, (D.LessThan, D.LessThanOrEqual)):
                    self.low[name] = max(x for x in (self.low[name], f.value + strict) if x is not None)
                if not isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
                    self.high[name] = min(x for x in (self.high[name], f.value - strict) if x is not None)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        filesystem, at = located(self.path)
        found = filesystem.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(at, recursive=True))
        parts = []
        for info in sorted(files, key=lambda i: i.path):
            name = re.sub(r"\.[^.]*$", "", info.base_name)
            if info.type == fs.FileType.File and re.fullmatch(self.glob, info.base_name) and (self.stems is None or name in self.stems):
                scheme = re.match(r"[a-z0-9]+://[^/]*", self.path)
                full = info.path if not scheme or self.path.startswith("file:") else self._uri(scheme[0], info.path)
                parts += [Rows(full, name, k, self.groups) for k in range(self.groups)]
        return parts

    @staticmethod
    def _uri(scheme: str, path: str) -> str:
        """Stores differ in whether a path holds the bucket that the URI names."""
        host = scheme.split("://")[1]
        return f"{scheme.split('://')[0]}://{path.lstrip('/')}" if host and path.lstrip("/").startswith(host) else f"{scheme}/{path.lstrip('/')}"

    def read(self, part: Rows) -> Iterator[tuple]:
        keep = lambda name, v: (self.low[name] is None or v >= self.low[name]) and (self.high[name] is None or v <= self.high[name])
        try:
            source = Ranges(part.path)
            head = header_of(source)
            source.close()
        except FAULTS as e:
            if part.k == 0:
                yield (part.name, None, None, None, None, None, None, 0, str(e))
            return
        rows = range(0, head["height"], self.stride)
        mine = [y for i, y in enumerate(rows) if i * part.n // len(rows) == part.k and keep("y_off", y)]
        wanted = [(x, y, self.tile, self.tile) for y in mine for x in range(0, head["width"], self.stride) if keep("x_off", x)]
        if wanted:
            for row in _windows(part.path, part.name, wanted):
                yield (*row[:6], None if row[6] is None else row[6].tolist(), *row[7:])


class Tiles(D.DataSource):
    """Option `path` (a folder or a file), `tile`, `stride`, `groups` (partitions a file), `glob` (a regular expression of file names)."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return WINDOW

    def reader(self, schema) -> TilesReader:
        return TilesReader(dict(self.options))


@dataclass
class Written(D.WriterCommitMessage):
    """Names that one task has written, and where."""

    folder: str
    names: list


class FilesWriter(D.DataSourceWriter):
    """Rows (name, content) as files of a folder. Tasks write beside the folder's files, the driver moves what finished tasks
    report once all have finished, and takes the rest away: a job that fails leaves nothing, a task that runs twice leaves one file."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        filesystem, at = located(self.path)
        folder = f"{at}/_{self.job}/{uuid.uuid4().hex}"
        filesystem.create_dir(folder, recursive=True)
        names = []
        for r in rows:
            with filesystem.open_output_stream(f"{folder}/{r.name}") as f:
                f.write(bytes(r.content))
            names.append(r.name)
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        filesystem, at = located(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for info in filesystem.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    filesystem.delete_file(info.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: filesystem.move(*x), [(f"{m.folder}/{n}", f"{at}/{n}") for m in done for n in m.names]))
        self._clear(filesystem, at)

    def abort(self, messages: list) -> None:
        self._clear(*located(self.path))

    def _clear(self, filesystem, at: str) -> None:
        if filesystem.get_file_info(f"{at}/_{self.job}").type == fs.FileType.Directory:
            filesystem.delete_dir(f"{at}/_{self.job}")


class TileFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes `raster_tiles` and `tile_files` known to a session, and lets filters reach Python data sources."""
    spark.dataSource.register(Tiles)
    spark.dataSource.register(TileFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tiles(spark: SparkSession, path: str, tile: int = 768, stride: int | None = None, groups: int = 8) -> DataFrame:
    """WINDOW rows of the grid over every file of a folder; filters on stem, x_off and y_off decide what is read."""
    register(spark)
    return spark.read.format("raster_tiles").options(path=path, tile=tile, stride=stride or tile, groups=groups).load()


def tile_name(stem_: str, x: int, y: int, kind: str) -> str:
    return f"{stem_}_{x}_{y}.{kind}"


def encoded_tiles(tiles: DataFrame, kind: str = "png", epsg: int | None = None) -> DataFrame:
    """(name, content) of tiles (stem, x_off, y_off, height, width, bands, samples and, for tif, transform); Parquet keeps them as they are."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame.to_dict("records"):
                x = np.asarray(t["samples"]).reshape(t["height"], t["width"], t["bands"]).clip(0, 255).astype(np.uint8)
                place = t["transform"] if kind == "tif" and isinstance(t.get("transform"), dict) else None
                content = png_bytes(x) if kind == "png" else tiff_bytes(x[:, :, :3], [place[c] for c in "abcdef"] if place else None, epsg)
                rows.append((tile_name(t["stem"], t["x_off"], t["y_off"], kind), content))
            yield pd.DataFrame(rows, columns=["name", "content"])

    return tiles.mapInPandas(work, "name string, content binary")


def write_tiles(encoded: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each row of (name, content) in a folder of any store; all appear, or none. Files of the same names are replaced."""
    register(encoded.sparkSession)
    encoded.select("name", "content").write.format("tile_files").mode("overwrite" if overwrite else "append").save(folder)
