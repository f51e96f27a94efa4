"""TIFF headers and windows, tiles written and read back."""

import os
import zlib

import numpy as np
import pytest

from skymosaic.sources import rasters


@pytest.mark.parametrize("kind,packed", [(np.uint8, True), (np.uint16, False)])
def test_headers_and_windows(spark, tmp_path, kind, packed):
    rng = np.random.default_rng(1)
    pictures = {f"p{k}": rng.integers(0, np.iinfo(kind).max, (300 + k, 401, bands)).astype(kind) for k, bands in enumerate((1, 3, 4))}
    for name, x in pictures.items():
        (tmp_path / f"{name}.tif").write_bytes(rasters.tiff_bytes(x, (0.5, 0.0, 1000.0, 0.0, -0.5, 2000.0), 32739, packed))
    (tmp_path / "bad.tif").write_bytes(b"no picture")
    rows = {r.stem: r for r in rasters.read_headers(spark, str(tmp_path)).collect()}
    assert rows.pop("bad").error
    assert {(n, r.width, r.height, r.bands, r.epsg, tuple(r.transform)) for n, r in rows.items()} == {(n, 401, x.shape[0], x.shape[2], 32739, (0.5, 0.0, 1000.0, 0.0, -0.5, 2000.0)) for n, x in pictures.items()}
    asked = [(n, x, y, w, h) for n in [*pictures, "bad"] for x, y, w, h in ((0, 0, 64, 64), (390, 290, 64, 64), (-10, 5, 20, 700), (500, 0, 5, 5), (37, 150, 301, 2))]
    found = rasters.read_windows(spark, str(tmp_path), spark.createDataFrame(asked, "stem string, x_off long, y_off long, w long, h long")).collect()
    assert len(found) == len(asked)
    size = {(n, x, y): (w, h) for n, x, y, w, h in asked}
    for r in found:
        if r.stem == "bad":
            assert r.error and r.samples is None
            continue
        w, h = size[r.stem, r.x_off, r.y_off]
        expected = pictures[r.stem][max(r.y_off, 0) : r.y_off + h, max(r.x_off, 0) : r.x_off + w]
        assert np.array_equal(np.array(r.samples).reshape(r.height, r.width, r.bands), expected) if expected.size else not r.samples


def test_big_endian_header():
    import struct

    entries = [(256, 4, 7), (257, 4, 5)]
    content = struct.pack(">4sI", b"MM\0*", 8) + struct.pack(">H", 2) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in entries) + struct.pack(">I", 0)
    h = rasters.header_of(content)
    assert (h["width"], h["height"], h["bands"], h["epsg"], h["transform"]) == (7, 5, 1, None, None)


def test_tiles_are_written_and_read(spark, tmp_path):
    x = np.random.default_rng(2).integers(0, 256, (6, 8, 3))
    tile = ("s", 384, 768, 6, 8, 3, [float(v) for v in x.ravel()], (1.0, 0.0, 5.0, 0.0, -1.0, 9.0))
    tiles = spark.createDataFrame([tile], "stem string, x_off long, y_off long, height int, width int, bands int, samples array<double>, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    for kind in ("png", "tif"):
        rasters.write_tiles(rasters.encoded_tiles(tiles, kind, 32739), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["s_384_768.png", "s_384_768.tif"]
    png = (tmp_path / "s_384_768.png").read_bytes()
    body = png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(6, 25)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and np.array_equal(lines[:, 1:].reshape(6, 8, 3), x)
    tif = (tmp_path / "s_384_768.tif").read_bytes()
    assert np.array_equal(rasters.window_of(tif, 0, 0, 8, 6), x) and rasters.header_of(tif)["epsg"] == 32739
