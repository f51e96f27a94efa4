"""Queries of standardising, silhouettes, mixtures and pixel mathematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, layout, tiling
from .registry import query


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null")


@query("""
    SELECT vec_id, dim, round(CASE WHEN std = 0 THEN 0e0 ELSE (v-mean)/std END, 6) AS value FROM
    (SELECT *, avg(v) OVER (PARTITION BY dim) mean, stddev_pop(v) OVER (PARTITION BY dim) std FROM
     (SELECT vec_id, unnest(range(66)) dim, unnest(list_concat(CAST(embedding AS DOUBLE[]), [CAST(label AS DOUBLE), CAST(vec_id%17 AS DOUBLE)])) v FROM embeddings) a) b""")
def feature_standardise(spark, sf_dir):
    rows = cluster.assemble(_embeddings(spark, sf_dir).withColumn("extra", F.col("vec_id") % 17), "embedding", "label", "extra")
    return cluster.standardise(rows, "vec_id").select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("""
    SELECT id vec_id, own label, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0e0 ELSE (b-a)/greatest(a, b) END, 6) silhouette FROM
    (SELECT id, own, max(CASE WHEN own = other AND n > 1 THEN d/(n-1) END) a, min(CASE WHEN own <> other THEN d/n END) b FROM
     (SELECT p.vec_id id, p.label own, q.label other, sum(list_distance(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) d, count(*) n FROM embeddings p CROSS JOIN embeddings q GROUP BY 1, 2, 3) s GROUP BY 1, 2) t""")
def exact_silhouette(spark, sf_dir):
    return cluster.silhouette(_embeddings(spark, sf_dir), "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


def _reduced(spark, sf_dir, k: int):
    rows = cluster.standardised(cluster.assemble(_embeddings(spark, sf_dir), "embedding"))
    return cluster.principal_components(rows, k)


@query()
def pca_gmm_clusters(spark, sf_dir):
    return cluster.mixture(_reduced(spark, sf_dir, 10), 5)[0].select("vec_id", "pca_1d", "cluster")


@query()
def gmm_bic_select(spark, sf_dir):
    return cluster.select_by_bic(_reduced(spark, sf_dir, 50))


@query()
def gmm_silhouette_select(spark, sf_dir):
    return cluster.select_by_silhouette(_reduced(spark, sf_dir, 30).select("vec_id", "pca"), "vec_id")


@query()
def tsne_layout(spark, sf_dir):
    """A picture of all vectors."""
    return layout.embed_2d(_embeddings(spark, sf_dir), "vec_id", "embedding")


_LIMITS = "SELECT l_suppkey, quantile_cont(l_extendedprice, 0.01) lo, quantile_cont(l_extendedprice, 0.99) hi FROM lineitem GROUP BY 1"


@query(f"""
    SELECT l_suppkey image, stretched, count(*) n FROM
    (SELECT p.l_suppkey, CAST(CASE WHEN hi = lo THEN 0 ELSE trunc(greatest(1e0, least(254e0, (l_extendedprice-lo)/(hi-lo)*255e0))) END AS INT) stretched FROM lineitem p JOIN ({_LIMITS}) l ON p.l_suppkey = l.l_suppkey) a GROUP BY 1, 2""")
def contrast_stretch(spark, sf_dir):
    """Prices of each supplier stand for an image's samples; the histogram after stretching."""
    pixels = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("image"), F.col("l_extendedprice").alias("v"))
    out = pixels.join(tiling.limits(pixels, ["image"], "v"), "image").withColumn("stretched", tiling.stretch(F.col("v"), F.col("lo"), F.col("hi")))
    return out.groupBy("image", "stretched").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey image, CAST(min(l_quantity) AS DOUBLE) low, CAST(max(l_quantity) AS DOUBLE) high, min(l_quantity) = max(l_quantity) skipped FROM lineitem GROUP BY 1")
def empty_tile_skip(spark, sf_dir):
    """All lines of all suppliers."""
    return _skipped(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _skipped(rows):
    tiles = rows.groupBy(F.col("l_suppkey").alias("image")).agg(F.min("l_quantity").cast("double").alias("low"), F.max("l_quantity").cast("double").alias("high"))
    return tiles.select("image", "low", "high", (F.col("low") == F.col("high")).alias("skipped"))
