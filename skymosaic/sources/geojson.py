"""GeoJSON feature collections: scans that survive bad files, and their text form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import opened

POINT = "struct<x:double,y:double>"
POLYGON = "array<array<array<double>>>"


def _schema(properties: str, coordinates: str = "string") -> str:
    """`coordinates` as text: its depth tells polygons from multipolygons."""
    fields = ",".join(f"{a.strip().split()[0]}:{a.strip().split()[1]}" for a in properties.split(","))
    return f"struct<type:string,name:string,crs:struct<properties:struct<name:string>>,features:array<struct<type:string,properties:struct<{fields}>,geometry:struct<type:string,coordinates:{coordinates}>>>>"


def _ring(ring: Column) -> Column:
    """Points of a ring of coordinates; positions without two numbers are left out."""
    return F.transform(F.filter(ring, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def rings(kind: Column, coordinates: Column) -> Column:
    """Coordinates of outer rings: one for a polygon, one a part for a multipolygon; none for other or malformed ones."""
    one = F.array(F.from_json(coordinates, POLYGON))  # an array of one, so that a text is parsed once
    many = F.from_json(coordinates, f"array<{POLYGON}>")
    none = F.array().cast(POLYGON)
    polygon = F.transform(one, lambda c: F.when(F.size(c) > 0, F.array(c[0])).otherwise(none))[0]
    parts = F.transform(F.filter(many, lambda p: F.size(p) > 0), lambda p: p[0])
    return F.coalesce(F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", parts), none)


def _plain(feature: Column) -> Column:
    """Whether a feature is a polygon whose coordinates are all numbers."""
    numbers = F.flatten(F.flatten(feature["geometry"]["coordinates"]))
    return F.coalesce((feature["geometry"]["type"] == "Polygon") & (F.size(numbers) > 0) & ~F.exists(numbers, lambda v: v.isNull()), F.lit(False))


def parse_collections(texts: DataFrame, content: str, properties: str = "class_id int") -> DataFrame:
    """A row a polygon: the columns of `texts` but its content, `crs`, `properties` and `points` (ring without a closing point).

    Features without a geometry give a row with null points; text that is no collection gives none. Collections of nothing but
    sound polygons are parsed in one go, in others the coordinates of each feature are a text of their own.
    """
    parsed = texts.withColumn("__p", F.from_json(content, _schema(properties, POLYGON), {"mode": "PERMISSIVE"}))
    parsed = parsed.withColumn("__plain", F.coalesce(F.forall("__p.features", _plain), F.lit(False)))
    parsed = parsed.withColumn("__c", F.when(~F.col("__plain"), F.from_json(content, _schema(properties), {"mode": "PERMISSIVE"}))).drop(content)
    kept = [c for c in parsed.columns if c not in ("__p", "__plain", "__c")]
    told = lambda f, found: F.struct(f["properties"].alias("properties"), found.alias("rings"))
    plain = F.transform("__p.features", lambda f: told(f, F.array(f["geometry"]["coordinates"][0])))
    other = F.transform("__c.features", lambda f: told(f, rings(f["geometry"]["type"], f["geometry"]["coordinates"])))
    crs = F.when(F.col("__plain"), F.col("__p.crs.properties.name")).otherwise(F.col("__c.crs.properties.name"))
    features = parsed.select(*kept, crs.alias("crs"), F.explode(F.when(F.col("__plain"), plain).otherwise(other)).alias("f"))
    return features.select(*kept, "crs", "f.properties", F.explode_outer("f.rings").alias("ring")).withColumn("points", F.transform(F.transform(F.array("ring"), _ring), opened)[0]).drop("ring")


def read(spark: SparkSession, path: str, properties: str = "class_id int") -> tuple[DataFrame, DataFrame]:
    """(polygons, bad files) of a folder; suffixes in any case, `file` names where a row is from. A bad file stops nothing."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.[gG][eE][oO][jJ][sS][oO][nN]").option("ignoreCorruptFiles", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    bad = files.filter(F.from_json("content", _schema(properties)).getField("type").isNull()).select("file")
    return parse_collections(files, "content", properties), bad


def collections(rows: DataFrame, keys: Sequence[str], points: str = "points", properties: str = "properties", name: str | None = None, epsg: int | None = None) -> DataFrame:
    """(keys, content): one collection of each key. A collection is one text by its nature, so keys bound its size."""
    feature, head = _feature(points, properties), _head(name, epsg)
    return rows.groupBy(*keys).agg(F.collect_list(feature).alias("features")).select(*keys, F.to_json(F.struct(*head, "features")).alias("content"))


def _feature(points: str, properties: str) -> Column:
    ring = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    return F.struct(F.lit("Feature").alias("type"), F.col(properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))


def _head(name: str | None, epsg: int | None) -> list[Column]:
    head = [F.lit("FeatureCollection").alias("type")]
    if name:
        head.append(F.lit(name).alias("name"))
    if epsg:
        head.append(F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"EPSG:{epsg}").alias("name")).alias("properties")).alias("crs"))
    return head


def packed_collections(rows: DataFrame, keys: Sequence[str], points: str = "points", properties: str = "properties", name: str | None = None, epsg: int | None = None, of: str | None = None) -> DataFrame:
    """(keys, content): collections of what lies together; a key has as many as there are Arrow batches that hold it.

    Nothing is shuffled, and a collection has as many features as a batch at most (spark.sql.execution.arrow.maxRecordsPerBatch).
    With `of`, an array of structs of the keys, a row is a feature of each of these collections, and its text is made once.
    """
    held = F.array(F.struct(*keys)) if of is None else F.transform(of, lambda k: F.struct(*[k[c].alias(c) for c in keys]))
    texts = rows.select(held.alias("keys"), F.to_json(_feature(points, properties)).alias("text"), F.to_json(F.struct(*_head(name, epsg))).alias("head"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, text, head = batch.columns
            row, key = pc.list_parent_indices(held).to_numpy(zero_copy_only=False), held.flatten()
            if not len(key):
                continue
            code = np.zeros(len(key), np.int64)
            for c in key.flatten():
                named = c.dictionary_encode(null_encoding="encode")
                code = code * len(named.dictionary) + named.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            features = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), text.take(pa.array(row[order]))), ",")
            content = [f"{head[0].as_py()[:-1]},\"features\":[{f}]}}" for f in features.to_pylist()]
            yield pa.RecordBatch.from_arrays([key.take(pa.array(order[first])), pa.array(content, pa.string())], ["key", "content"])

    schema = T.StructType([T.StructField("key", texts.schema["keys"].dataType.elementType), T.StructField("content", T.StringType())])
    return texts.mapInArrow(work, schema).select("key.*", "content")
