"""Polygons of shapefiles (.shp with .shx and .dbf beside it) as a data source; records are read by byte ranges, a partition a group of them.

Rings that run clockwise bound land, the others are holes. A record that is damaged is told in its row; a file whose head is
damaged raises ValueError. Null shapes have no rings.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .files import Ranges

SCHEMA = "record int, attributes map<string,string>, rings array<struct<points:array<struct<x:double,y:double>>,hole:boolean>>, error string"
# The format's number, and its kinds of shapes that are polygons (plain, with heights, with measures).
MAGIC, POLYGONS, NOTHING = 9994, (5, 15, 25), 0


def rings_of(shape: bytes) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points without the closing one, hole) of the rings of one record's shape."""
    kind = struct.unpack_from("<i", shape)[0]
    if kind == NOTHING:
        return []
    if kind not in POLYGONS:
        raise ValueError(f"shape of kind {kind} is no polygon")
    n_parts, n_points = struct.unpack_from("<ii", shape, 36)
    if min(n_parts, n_points) < 0 or 44 + 4 * n_parts + 16 * n_points > len(shape):
        raise ValueError("the record is too short")
    starts = [*struct.unpack_from(f"<{n_parts}i", shape, 44), n_points]
    if any(a > b or a < 0 for a, b in zip(starts, starts[1:])):
        raise ValueError("parts are out of order")
    flat = struct.unpack_from(f"<{2 * n_points}d", shape, 44 + 4 * n_parts)
    out = []
    for a, b in zip(starts, starts[1:]):
        ring = list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2]))
        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
        if len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        out.append((ring, turn > 0))
    return out


class Table:
    """Fields and records of a .dbf file."""

    def __init__(self, source: Ranges):
        head = source.read(0, 32)
        self.source = source
        self.count, self.start, self.size = struct.unpack_from("<IHH", head, 4)
        if self.start < 33 or self.size < 1:
            raise ValueError("no table of attributes")
        self.fields, at = [], 1
        for k in range((self.start - 33) // 32):
            field = source.read(32 + 32 * k, 32)
            if field[0] == 0x0D:
                break
            self.fields.append((field[:11].split(b"\0")[0].decode("latin-1"), at, field[16]))
            at += field[16]

    def row(self, k: int) -> dict[str, str]:
        data = self.source.read(self.start + k * self.size, self.size)
        return {name: data[a : a + n].decode("utf-8", "replace").strip(" \0") for name, a, n in self.fields}


@dataclass
class Records(D.InputPartition):
    begin: int
    end: int


class Reader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("records", 1000))

    def _beside(self, ending: str) -> str:
        return re.sub(r"\.shp$", ending, self.path, flags=re.IGNORECASE)

    def partitions(self) -> list[Records]:
        index = Ranges(self._beside(".shx"))
        if index.size < 100 or struct.unpack(">i", index.read(0, 4))[0] != MAGIC:
            raise ValueError(f"{self._beside('.shx')} is no index of shapes")
        n = (index.size - 100) // 8
        index.close()
        return [Records(k, min(k + self.records, n)) for k in range(0, n, self.records)]

    def read(self, part: Records) -> Iterator[tuple]:
        index, shapes, table = Ranges(self._beside(".shx")), Ranges(self.path), Table(Ranges(self._beside(".dbf")))
        for k in range(part.begin, part.end):
            attributes = None
            try:
                attributes = table.row(k)
                at, size = (2 * x for x in struct.unpack(">ii", index.read(100 + 8 * k, 8)))
                number, stated = struct.unpack(">ii", shapes.read(at, 8))
                if number != k + 1 or 2 * stated != size:
                    raise ValueError("the record is not where the index says")
                yield (k, attributes, [{"points": [{"x": x, "y": y} for x, y in ring], "hole": hole} for ring, hole in rings_of(shapes.read(at + 8, size))], None)
            except (ValueError, struct.error) as e:
                yield (k, attributes, None, str(e))


class Shapes(D.DataSource):
    """Options `path` (of the .shp file) and `records` (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_shapes(spark: SparkSession, path: str, records: int = 1000) -> DataFrame:
    spark.dataSource.register(Shapes)
    return spark.read.format("shapefile").options(path=path, records=records).load()


def read_land(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """(record, points, hole) of the rings of the records whose attribute is `value`; ValueError where there are none, or a damaged one."""
    found = read_shapes(spark, path).filter(F.col("attributes")[field] == value)
    state = found.agg(F.count("*").alias("n"), F.max("error").alias("error")).first()
    if not state.n:
        raise ValueError(f"no record whose {field} is {value}")
    if state.error:
        raise ValueError(f"a record whose {field} is {value} is damaged: {state.error}")
    return found.select("record", F.inline("rings"))
