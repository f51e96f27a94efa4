"""Files of every kind that is read, made by hand; damaged ones are told; ranges grow with the windows; tiles are committed together."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymosaic.sources import rasters, tiff
from skymosaic.sources.files import Held, Ranges


def pack_lzw(data):
    """The plain textbook writer, codes high bits first."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table, width = {bytes([k]): k for k in range(256)}, 9
    put(256, 9)
    n, text = 258, b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if text + c in table:
            text += c
            continue
        put(table[text], width)
        table[text + c] = n
        n += 1
        if n == 4095:
            put(256, width)
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        elif n + 1 > 1 << width:
            width += 1
        text = c
    if text:
        put(table[text], width)
        n += 1
        if n + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def pack_bits(data):
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits, 32946: zlib.compress}


def made(x, compression=1, predictor=1, tile=None, planar=1, big=False, order="<", rows=7):
    """A file of rows x columns x bands with a block layout."""
    h, w, bands = x.shape
    bh, bw = tile or (rows, w)
    kind = x.dtype.newbyteorder(order)
    blocks = []
    for plane in range(bands if planar == 2 else 1):
        part = x[:, :, plane : plane + 1] if planar == 2 else x
        for y in range(0, h, bh):
            for c in range(0, w, bw):
                b = part[y : y + bh, c : c + bw]
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
                blocks.append(PACK[compression](np.ascontiguousarray(b).astype(kind).tobytes()))
    form = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [x.itemsize * 8] * bands), 259: (3, [compression]), 262: (3, [1]), 277: (3, [bands]), 284: (3, [planar]), 317: (3, [predictor]), 339: (3, [form] * bands)}
    start = 16
    at = np.cumsum([start, *map(len, blocks)]).tolist()
    wide = 16 if big else 4
    if tile:
        entries |= {322: (4, [bw]), 323: (4, [bh]), 324: (wide, at[:-1]), 325: (wide, [len(b) for b in blocks])}
    else:
        entries |= {273: (wide, at[:-1]), 278: (4, [bh]), 279: (wide, [len(b) for b in blocks])}
    field, count, entry = (8, "Q", "HHQ") if big else (4, "H", "HHI")
    place, extra, table = at[-1], b"", b""
    after = place + struct.calcsize(order + count) + len(entries) * (struct.calcsize(order + entry) + field) + field
    for tag in sorted(entries):
        kind_, values = entries[tag]
        data = struct.pack(f"{order}{len(values)}{tiff.SIZES[kind_]}", *values)
        table += struct.pack(order + entry, tag, kind_, len(values))
        if len(data) > field:
            table += struct.pack(order + ("Q" if big else "I"), after + len(extra))
            extra += data
        else:
            table += data.ljust(field, b"\0")
    first = struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, place) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, place).ljust(16, b"\0")
    return first + b"".join(blocks) + struct.pack(order + count, len(entries)) + table + b"\0" * field + extra


def picture(kind, bands, seed=1, h=41, w=67):
    rng = np.random.default_rng(seed)
    base = (np.add.outer(np.arange(h), np.arange(w))[:, :, None] * np.arange(1, bands + 1) + rng.integers(0, 5, (h, w, bands)))
    return (base % 251).astype(kind) if np.dtype(kind).kind != "f" else base.astype(kind) / 7


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 32946])
@pytest.mark.parametrize(("predictor", "tile", "planar", "big", "order", "kind"), [(1, None, 1, False, "<", "u1"), (2, None, 1, False, "<", "u1"), (2, (16, 32), 1, True, "<", "u2"), (1, (16, 16), 2, False, ">", "u2"), (2, None, 2, True, ">", "i2"), (1, (32, 16), 1, False, "<", "f4"), (2, (16, 16), 1, False, ">", "u4")])
def test_files_of_every_kind(compression, predictor, tile, planar, big, order, kind):
    for bands in (1, 3):
        x = picture(kind, bands)
        content = made(x, compression, predictor, tile, planar, big, order)
        head = tiff.header_of(content)
        assert (head["width"], head["height"], head["bands"]) == (67, 41, bands)
        for a, b, w, h in ((0, 0, 67, 41), (-5, -5, 20, 20), (13, 9, 30, 25), (60, 38, 50, 50), (66, 40, 1, 1), (70, 0, 5, 5)):
            want = x[max(b, 0) : max(b + h, 0), max(a, 0) : max(a + w, 0)]
            got = tiff.window_of(content, a, b, w, h)
            assert np.array_equal(got, want) if want.size else not got.size


def test_lzw_of_long_and_plain_texts():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 100_000, bytes(rng.integers(0, 256, 60_000).astype(np.uint8)), bytes(rng.integers(0, 3, 90_000).astype(np.uint8))):
        assert tiff.unpack_lzw(pack_lzw(data)) == data


def test_damaged_files_are_told():
    x = picture("u1", 3)
    for compression in (1, 5, 8):
        content = made(x, compression, 2, (16, 16))
        assert np.array_equal(tiff.window_of(content, 0, 0, 67, 41), x)
        for cut in (0, 3, 8, 15, 100, len(content) // 2, len(content) - 1):
            with pytest.raises(ValueError):
                tiff.window_of(content[:cut], 0, 0, 67, 41)
    broken = bytearray(made(x, 8, 1))
    broken[20:40] = b"\xff" * 20
    with pytest.raises(ValueError, match="damaged"):
        tiff.window_of(bytes(broken), 0, 0, 67, 41)
    with pytest.raises(ValueError, match="compression 7"):
        tiff.window_of(made(x, 1).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 7)), 0, 0, 5, 5)
    for seed in range(300):  # any byte may be wrong: a picture or a ValueError comes back, nothing else
        rng = np.random.default_rng(seed)
        content = bytearray(made(x, (1, 5, 8, 32773)[seed % 4], 1 + seed % 2, (16, 16) if seed % 3 else None))
        for k in rng.integers(0, len(content), 3):
            content[k] = rng.integers(0, 256)
        try:
            tiff.window_of(bytes(content), 0, 0, 30, 30)
        except (ValueError, *rasters.FAULTS, MemoryError):
            pass


def test_bytes_read_grow_with_the_windows(spark, tmp_path):
    x = np.random.default_rng(3).integers(0, 256, (2048, 2048, 3)).astype(np.uint8)
    path = tmp_path / "scene.tif"
    path.write_bytes(made(x, 1, 1, (128, 128)))
    source = Ranges(str(path))
    seen = tiff.Picture(source)
    head = source.fetched
    assert head < 200_000
    seen.window(10, 10, 100, 100)
    assert source.fetched - head == 128 * 128 * 3
    seen.window(300, 300, 400, 100)
    assert source.fetched - head == 128 * 128 * 3 * (1 + 4 * 2)
    few = rasters.read_tiles(spark, str(tmp_path), 256).filter("stem = 'scene' and y_off >= 1024 and y_off < 1280 and x_off < 512")
    rows = few.collect()
    assert {(r.x_off, r.y_off) for r in rows} == {(0, 1024), (256, 1024)}
    assert sum(r.fetched for r in rows) == 2 * 256 * 256 * 3
    for r in rows:
        assert np.array_equal(np.array(r.samples).reshape(256, 256, 3), x[r.y_off : r.y_off + 256, r.x_off : r.x_off + 256])
    asked = spark.createDataFrame([("scene", 0, 0, 128, 128), ("scene", 0, 0, 64, 64), ("none", 0, 0, 5, 5)], "stem string, x_off long, y_off long, w long, h long")
    assert sorted(r.fetched for r in rasters.read_windows(spark, str(tmp_path), asked).collect()) == [0, 128 * 128 * 3]


def test_filters_reach_the_source(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"s{k}.tif").write_bytes(made(picture("u1", 1, k, 200, 300), 8))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_bytes(b"no picture")
    every = rasters.read_tiles(spark, str(tmp_path), 100, 50, groups=3)
    assert every.filter("error is null").count() == 4 * 4 * 6 and [r.stem for r in every.filter("error is not null").collect()] == ["bad"]
    reader = rasters.TilesReader({"path": str(tmp_path), "tile": "100", "stride": "50", "groups": "3"})
    assert len(reader.partitions()) == 15
    left = list(reader.pushFilters([rasters.D.In(("stem",), ("s1", "s2")), rasters.D.GreaterThan(("x_off",), 0), rasters.D.LessThanOrEqual(("y_off",), 50), rasters.D.IsNotNull(("stem",))]))
    assert len(left) == 1 and len(reader.partitions()) == 6
    assert {r[:3] for p in reader.partitions() for r in reader.read(p)} == {(s, x, y) for s in ("s1", "s2") for x in range(50, 300, 50) for y in (0, 50)}
    assert every.filter(F.col("stem").isin("s1", "s2") & (F.col("x_off") > 0) & (F.col("y_off") <= 50)).count() == 20


def test_a_failing_task_leaves_no_tile(spark, tmp_path):
    folder = tmp_path / "tiles"
    tiles = spark.range(0, 40, 1, 4).select(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".png")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    rasters.write_tiles(tiles, str(folder))
    assert len(os.listdir(folder)) == 40 and (folder / "t7.png").read_bytes() == b"7"
    bad = tiles.withColumn("content", F.when(F.col("name") == "t39.png", F.raise_error(F.lit("broken"))).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="broken"):
        rasters.write_tiles(bad, str(folder))
    assert len(os.listdir(folder)) == 40 and {(folder / f).read_bytes() for f in os.listdir(folder)} == {str(k).encode() for k in range(40)}
    rasters.write_tiles(tiles.limit(3), f"file://{folder}", overwrite=True)
    assert len(os.listdir(folder)) == 3


def test_held_bytes_end():
    with pytest.raises(ValueError):
        Held(b"abc").read(1, 5)
