"""Files, collections and streams."""

import io
import json

import numpy as np
from pyspark.sql import functions as F

from skymosaic.sources import geojson, tables
from skymosaic.streaming import incremental


def test_geojson_folder(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    feature = lambda cls, kind, coords: {"type": "Feature", "properties": {"class_id": cls} if cls is not None else {}, "geometry": {"type": kind, "coordinates": coords}}
    good = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:32739"}}, "features": [feature(1, "Polygon", [ring]), feature(None, "MultiPolygon", [[ring[:-1]], [ring]]), feature(2, "Point", [1, 2])]}
    (tmp_path / "a.geojson").write_text(json.dumps(good))
    (tmp_path / "b.GeoJSON").write_text(json.dumps({"type": "FeatureCollection"}))
    (tmp_path / "c.geojson").write_text("{ not json")
    (tmp_path / "d.txt").write_text("{}")
    rows, bad = geojson.read(spark, str(tmp_path))
    found = rows.orderBy("properties.class_id").collect()
    assert [(r.crs, r.properties.class_id, r.points and len(r.points)) for r in found] == [("EPSG:32739", None, 4), ("EPSG:32739", None, 4), ("EPSG:32739", 1, 4), ("EPSG:32739", 2, None)]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["c.geojson"]


def test_collections_name_their_crs(spark):
    df = spark.createDataFrame([(1, [(0.5, 1.0), (2.0, 1.0), (2.0, 3.0)], (7,))], "tile int, points array<struct<x:double,y:double>>, properties struct<class_id:int>")
    (row,) = geojson.collections(df, ["tile"], name="boats", epsg=32739).collect()
    assert json.loads(row.content) == {"type": "FeatureCollection", "name": "boats", "crs": {"type": "name", "properties": {"name": "EPSG:32739"}}, "features": [{"type": "Feature", "properties": {"class_id": 7}, "geometry": {"type": "Polygon", "coordinates": [[[0.5, 1.0], [2.0, 1.0], [2.0, 3.0]]]}}]}


def test_label_files_and_listing(spark, tmp_path):
    (tmp_path / "t_0_0.txt").write_text("1 0 0 1 0 1 1 0 1\n\n")
    (tmp_path / "t_0_384.txt").write_text("")
    assert [(r.stem, r.class_id) for r in tables.read_label_files(spark, str(tmp_path)).collect()] == [("t_0_0", 1)]
    assert "t_0_0" in [r.stem for r in tables.list_files(spark, str(tmp_path), "*.txt").collect()]


def test_csv_headers_and_appending(spark, tmp_path):
    (tmp_path / "log.csv").write_text("  epoch,   time , a \n1, 2.5, x\n")
    assert tables.read_csv(spark, str(tmp_path / "log.csv")).columns == ["epoch", "time", "a"]
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for _ in range(2):
        tables.write_csv(df, str(tmp_path / "out"), ["s", "n"], append=True)
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), "s string, n int").collect())) == [("a", 1), ("a", 1)]


def test_names_of_files(spark):
    df = spark.createDataFrame([("images/val/src_1_384_0.png",), ("./a/b.c.tif",)], "p string")
    assert [tuple(r) for r in df.select(tables.stem(F.col("p")), tables.split_of(F.col("p")), tables.corrected(F.col("p"))).collect()] == [("src_1_384_0", "val", "images/val/src_1_384_0.png"), ("b.c", "a", "../a/b.c.tif")]


def test_pictures_keep_their_errors(spark, tmp_path):
    out = io.BytesIO()
    np.save(out, np.arange(6).reshape(1, 2, 3))
    (tmp_path / "a.npy").write_bytes(out.getvalue())
    (tmp_path / "b.npy").write_bytes(b"no picture")
    rows = {r.stem: r for r in tables.read_pictures(spark, str(tmp_path), tables.decode_npy, "*.npy").collect()}
    assert (rows["a"].height, rows["a"].width, rows["a"].bands, rows["a"].samples[-1]) == (1, 2, 3, 5.0) and rows["b"].error and rows["b"].samples is None


def test_png_header(spark):
    head = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    rows = spark.createDataFrame([(head,), (b"GIF89a",)], "c binary").select(tables.png_size(F.col("c"))).collect()
    assert tuple(rows[0][0]) == (640, 480) and rows[1][0] is None


def test_streams_add_what_is_new(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chip_id string, n int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.read_folder(spark, str(tmp_path / "in"), rows.schema)
    for _ in range(2):  # the second run finds nothing that is new
        incremental.upsert_new(stream(), str(tmp_path / "out"), ["chip_id"], str(tmp_path / "state")).awaitTermination()
        assert sorted(r.chip_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    spark.createDataFrame([("b", 4), ("c", 5)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.upsert_new(stream(), str(tmp_path / "out"), ["chip_id"], str(tmp_path / "state")).awaitTermination()
    assert sorted(r.chip_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    held = incremental.run_to_end(incremental.first_of_each(stream(), ["chip_id"]), "chips", str(tmp_path / "once"))
    assert held.count() == 3
