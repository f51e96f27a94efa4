"""Queries of codecs, joins of stems with metadata, prompts, incremental runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import inference, labels
from ..sources import geojson, tables
from ..streaming import incremental
from .fixtures import frame
from .registry import query


def _features(annotations):
    """Annotations written as feature collections, one for each source and bucket of them, and read again."""
    a = annotations.select(F.col("source_id"), F.pmod(F.xxhash64("ann_id"), F.lit(16)).alias("part"), F.struct(F.col("ann_id"), F.col("class_raw").alias("class_id")).alias("properties"), "points")
    texts = geojson.collections(a, ["source_id", "part"], "points", "properties")
    parsed = geojson.parse_collections(texts, "content", "ann_id string, class_id int")
    ring = G.closed(F.col("points"))
    return parsed.select("properties.ann_id", "source_id", "properties.class_id", F.size(ring).alias("ring_points"), F.round(F.col("points")[0]["x"], 6).alias("px0"), F.round(F.col("points")[2]["y"], 6).alias("py2"))


@query("SELECT ann_id, source_id, CAST(class_raw AS INT) class_id, CAST(5 AS INT) ring_points, round(x0, 6) px0, round(y2, 6) py2 FROM annotations")
def geojson_features(spark, sf_dir):
    """Annotations of all classes."""
    return _features(frame(spark, sf_dir, "annotations"))


_CONTENT = "concat('\n', CAST(l_partkey%7 AS STRING), ' 0.125 0.25 0.5 0.25 0.5 0.', CAST(l_linenumber AS STRING), '5 0.125 0.75\r\n   \n', CASE WHEN l_orderkey%3 = 0 THEN 'broken line\n' ELSE '1 0 0 1 0 1 1 0 1\n' END)"


@query("SELECT l_orderkey%100 AS file, l_partkey%7 class_id, count(*) n, round(sum(CAST(concat('0.', CAST(l_linenumber AS VARCHAR), '5') AS DOUBLE)), 4) ys FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_orderkey%100, -1, count(*), round(count(*)*1e0, 4) FROM lineitem WHERE l_orderkey%3 <> 0 GROUP BY 1")
def label_text_parse(spark, sf_dir):
    """Label files' lines: blank and malformed ones go. The second line of a file counts as class -1."""
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 100).alias("file"), F.expr(_CONTENT).alias("content"))
    rows = files.select("file", F.posexplode(labels.parse_lines(F.col("content"))).alias("at", "row"))
    class_id = F.when(F.col("at") == 0, F.col("row.class_id").cast("long")).otherwise(F.lit(-1).cast("long"))
    return rows.groupBy("file", class_id.alias("class_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("row.corners")[2]["y"]), 4).alias("ys"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s) <> '')) AS BIGINT) lines FROM documents")
def text_lines(spark, sf_dir):
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != "")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(lines).cast("long").alias("lines"))


@query("SELECT tile_id, CASE WHEN tile_id%9 = 0 THEN NULL WHEN tile_id%4 = 0 THEN y_off+1 ELSE y_off END row_off, tile_id%9 = 0 missing FROM tiles")
def missing_metadata_anti(spark, sf_dir):
    """Images with their metadata, of which the last row of a stem counts."""
    tiles = frame(spark, sf_dir, "tiles")
    meta = tiles.filter("tile_id % 9 <> 0").select("tile_id", F.col("y_off").alias("row_off"), F.col("tile_id").alias("row"))
    meta = meta.unionByName(meta.filter("tile_id % 4 = 0").select("tile_id", (F.col("row_off") + 1).alias("row_off"), (F.col("row") + 1_000_000).alias("row")))
    out = tiles.select("tile_id").join(tables.last_of_each(meta, ["tile_id"], "row"), "tile_id", "left")
    return out.select("tile_id", "row_off", F.col("row").isNull().alias("missing"))


@query("SELECT concat(source_tif, '_', ann_id) chip_id FROM annotations a JOIN sources s ON a.source_id = s.source_id WHERE class_raw IN (0, 2) AND l_orderkey%3 <> 0")
def incremental_chips(spark, sf_dir):
    chips = frame(spark, sf_dir, "annotations").filter(F.col("class_raw").isin(0, 2)).join(frame(spark, sf_dir, "sources"), "source_id").withColumn("chip_id", F.concat_ws("_", "source_tif", "ann_id"))
    return incremental.not_yet(chips, chips.filter("l_orderkey % 3 = 0"), ["chip_id"]).select("chip_id")


@query("SELECT tile_id, p.k prompt_index, CASE p.k WHEN 0 THEN 'boat' WHEN 1 THEN 'house' ELSE 'unknown' END prompt FROM tiles CROSS JOIN (SELECT unnest([0, 1, 2]) k) p")
def prompt_cross_tiles(spark, sf_dir):
    prompts = ["boat", "house"]
    indexes = spark.createDataFrame([(0,), (1,), (2,)], "prompt_index int")
    out = frame(spark, sf_dir, "tiles").select("tile_id").crossJoin(F.broadcast(indexes))
    return out.withColumn("prompt", inference.prompt_name(F.col("prompt_index"), prompts))


@query("SELECT event_type, count(DISTINCT event_id) n, CAST(round(sum(value), 2) AS DOUBLE) total FROM events GROUP BY 1")
def stream_dedup_events(spark, sf_dir):
    """Events read as a stream, one row of each id, and what its sink holds when the input is used up."""
    events = incremental.read_folder(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, "events.parquet")
    held = incremental.run_to_end(incremental.first_of_each(events, ["event_id"], "ts"), "events")
    return held.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
