"""Coasts walked through map tiles, shares of land, shapefiles, counters beside a write, and paced requests."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymosaic.operators import coast, inference, spatial
from skymosaic.session import checkpointed
from skymosaic.sources import shapefile

LAND = "points array<struct<x:double,y:double>>, hole boolean"


def tile_of(x, y, zoom):
    return int((x + 180) / 360 * 2**zoom // 1), int((1 - math.asinh(math.tan(math.radians(y))) / math.pi) / 2 * 2**zoom // 1)


def test_walked_tiles_are_those_of_many_points(spark):
    rng = random.Random(1)
    ring = [(46 + rng.uniform(-0.5, 0.5), -18 + rng.uniform(-0.5, 0.5)) for _ in range(15)] + [(46.0, -18.3), (46.0, -17.6), (46.4, -17.6)]
    got = {(r.x, r.y) for r in coast.coast_tiles(spark.createDataFrame([(ring, False)], LAND), 12).collect()}
    want = set()
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        want |= {tile_of(a + (c - a) * t, b + (d - b) * t, 12) for t in np.linspace(0, 1, 4001)}
    assert want <= got
    for x, y in got - want:  # a corner clipped between two points: the side comes within a hair of the tile
        w, e = x / 4096 * 360 - 180, (x + 1) / 4096 * 360 - 180
        assert any(min(a, c) <= e and w <= max(a, c) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))
    assert len(got - want) <= 3 and len(got) == len(coast.coast_tiles(spark.createDataFrame([(ring, False), (ring, True)], LAND), 12).collect())


def test_share_of_land_with_holes(spark):
    n = 400
    outer = [(46 + 0.4 * math.cos(2 * math.pi * k / n), -18 + 0.3 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    lake = [(46 + 0.1 * math.cos(2 * math.pi * k / n), -18 + 0.1 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    land = spark.createDataFrame([(outer, False), (lake[::-1], True), ([(1.0, 1.0)], False), ([], False)], LAND)
    tiles = coast.coast_tiles(land, 11)
    plain = {(r.x, r.y): r for r in coast.land_share(tiles, land, 0.1).collect()}
    metric = {(r.x, r.y): r.land_ratio for r in coast.land_share(tiles, land, 0.1, zone=38).collect()}
    assert len(plain) == tiles.count() > 12
    for key, r in plain.items():
        x, y = np.meshgrid(np.linspace(r.west, r.east, 400, endpoint=False) + (r.east - r.west) / 800, np.linspace(r.south, r.north, 400, endpoint=False) + (r.north - r.south) / 800)
        inside = (((x - 46) / 0.4) ** 2 + ((y + 18) / 0.3) ** 2 < 1) & ((x - 46) ** 2 + (y + 18) ** 2 > 0.01)
        assert r.land_ratio == pytest.approx(inside.mean(), abs=0.005) and metric[key] == pytest.approx(r.land_ratio, abs=0.01)
    assert coast.coast_tiles(land.limit(0), 10).count() == 0


def record(parts, kind=5):
    if kind == 0:
        return struct.pack("<i", 0)
    points = [p for part in parts for p in part]
    starts = np.cumsum([0, *map(len, parts)])[:-1].tolist()
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def write_shapes(path, rows):
    """A plain writer of the three files; rows: (attributes, shape bytes)."""
    names = sorted({k for a, _ in rows for k in a})
    body, index, at = b"", b"", 50
    for k, (_, shape) in enumerate(rows):
        index += struct.pack(">ii", at, len(shape) // 2)
        body += struct.pack(">ii", k + 1, len(shape) // 2) + shape
        at += 4 + len(shape) // 2
    head = lambda n: struct.pack(">i20xi", 9994, 50 + n // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    (path / "land.shp").write_bytes(head(len(body)) + body)
    (path / "land.shx").write_bytes(head(len(index)) + index)
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14 for n in names) + b"\r"
    size = 1 + 20 * len(names)
    table = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 32 + len(fields), size) + fields
    table += b"".join(b" " + b"".join(a.get(n, "").encode().ljust(20)[:20] for n in names) for a, _ in rows)
    (path / "land.dbf").write_bytes(table)
    return str(path / "land.shp")


def test_shapefiles(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]  # clockwise: land
    lake = [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]
    rows = [({"ADMIN": f"land {k}", "ISO": str(k)}, record([[(x + k, y) for x, y in square]])) for k in range(25)]
    rows += [({"ADMIN": "Lakeland", "ISO": "é"}, record([square, lake])), ({"ADMIN": "Nowhere"}, record([], 0)), ({"ADMIN": "Points"}, record([square], 8)), ({"ADMIN": "Heights"}, record([square], 15))]
    path = write_shapes(tmp_path, rows)
    found = {r.attributes["ADMIN"]: r for r in shapefile.read_shapes(spark, path, records=4).collect()}
    assert len(found) == 29 and found["Nowhere"].rings == [] and "kind 8" in found["Points"].error and found["Lakeland"].attributes["ISO"] == "é"
    assert [tuple(p) for p in found["land 3"].rings[0].points] == [(x + 3, y) for x, y in square[:-1]] and found["Heights"].rings
    land = shapefile.read_land(spark, path, "ADMIN", "Lakeland")
    assert sorted((len(r.points), r.hole) for r in land.collect()) == [(4, False), (4, True)]
    tiles = spark.createDataFrame([(0.0, 0.0, 9.0, 9.0)], "west double, south double, east double, north double")
    assert coast.land_share(tiles, land, 2.0).first().land_ratio == pytest.approx(72 / 81)
    with pytest.raises(ValueError, match="no record whose ADMIN is Atlantis"):
        shapefile.read_land(spark, path, "ADMIN", "Atlantis")
    with pytest.raises(ValueError, match="kind 8"):
        shapefile.read_land(spark, path, "ADMIN", "Points")
    data = bytearray((tmp_path / "land.shp").read_bytes())
    data[100 + 8 + 36 : 100 + 8 + 40] = struct.pack("<i", 10**6)
    (tmp_path / "land.shp").write_bytes(bytes(data[:-40]))
    broken = {r.attributes["ADMIN"]: r.error for r in shapefile.read_shapes(spark, path).collect()}
    assert broken["land 0"] and broken["Heights"] and not broken["land 1"]
    (tmp_path / "land.shx").write_bytes(b"x" * 200)
    with pytest.raises(Exception, match="no index"):
        shapefile.read_shapes(spark, path).collect()


def test_counters_equal_a_second_pass_in_one_job(spark):
    rng = random.Random(4)
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + 5), (x, y + 5)]
    rows = [(f"a{i}", i % 3, rng.choice([0, 1, 6, 9, None]), ring(rng.uniform(-5, 1500), rng.uniform(-5, 1500), rng.choice([0.0, 8.0, 300.0]))) for i in range(400)]
    annotations = spark.createDataFrame(rows, "ann_id string, source_id int, class_raw int, points array<struct<x:double,y:double>>")
    tiles = spark.createDataFrame([(s, s * 100 + k, 384 * (k % 4), 384 * (k // 4), 768, 768) for s in range(3) for k in range(16)], "source_id int, tile_id int, x_off long, y_off long, tw long, th long")
    labels, counted = spatial.counted_join(tiles, annotations, quads=True)
    kept = checkpointed(labels.select("tile_id", "ann_id", "visible"))
    got = counted()
    wanted = [r for r in rows if r[2] in (0, 1, 6)]
    sound = [r for r in wanted if r[3][1][0] > r[3][0][0]]
    assert (got["read"], got["dropped_class"], got["dropped_geometry"]) == (400, 400 - len(wanted), len(wanted) - len(sound))
    again = spatial.tile_annotation_join(tiles, annotations.filter(F.col("ann_id").isin([r[0] for r in sound])), keep_all=True, quads=True).select("visible").collect()
    assert got["pairs"] == len(again) == got["kept"] + got["dropped_visible"] and got["kept"] == kept.count() == sum(r.visible >= 0.25 for r in again)
    assert got["touching"] == sum(r.visible == 0 for r in again)


def test_the_rate_is_held_over_eight_tasks():
    rate, parts, asked = 20.0, 8, []
    for k in range(parts):  # tasks run side by side, each with its own view of one clock
        now = [0.0]
        pace = inference.Pace(rate, k, parts, lambda n=now: n[0], lambda s, n=now: n.__setitem__(0, n[0] + s))
        rng = random.Random(k)
        while now[0] < 30:
            pace.wait()
            asked.append(now[0])
            now[0] += rng.choice([0.0, 0.01, 0.7])  # what the answer takes
    asked.sort()
    for i, t in enumerate(asked):
        assert sum(1 for u in asked[i:] if u < t + 1.0) <= rate + parts
    assert len(asked) <= rate * 30 + parts


def test_retries_and_reasons(spark):
    slept = []
    answers = iter([(503, b""), OSError("slow"), (200, b"x" * 10)])

    def get(z, x, y):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert inference.asked(get, 1, 1, 1, 5, 3, None, 0.5, slept.append) == (b"x" * 10, None, 3) and slept == [0.5, 1.0]
    assert inference.asked(lambda *_: (404, b""), 1, 1, 1, 5, 3, None) == (None, "status 404", 1)
    assert inference.asked(lambda *_: (200, b""), 1, 1, 1, 5, 3, None) == (None, "blank", 1)
    assert inference.asked(lambda *_: (429, b""), 1, 1, 1, 5, 2, None, 0.0) == (None, "status 429", 3)

    def make():
        return lambda z, x, y: (200, b"y" * 9000) if x % 2 else (500, b"")

    tiles = spark.createDataFrame([(3, x, 0) for x in range(6)], "zoom int, x long, y long")
    assert sorted(r.x for r in inference.fetch(tiles, make).collect()) == [1, 3, 5]
    rows = inference.fetch(tiles, make, rate=200.0, parts=4, retries=1, failures=True).collect()
    assert {(r.x, r.error, r.attempts) for r in rows} == {(x, None, 1) if x % 2 else (x, "status 500", 2) for x in range(6)}
    with pytest.raises(ValueError, match="rate"):
        inference.fetch(tiles, make, rate=0)
