"""Standardising, reducing and clustering feature vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.files import located


def assemble(df: DataFrame, image: str, *extra: str) -> DataFrame:
    """`features`: the image vector and scalar columns behind it."""
    return df.withColumn("features", F.concat(F.col(image).cast("array<double>"), *([F.array(*[F.col(c).cast("double") for c in extra])] if extra else [])))


def standardise(df: DataFrame, id_col: str, vector: str = "features") -> DataFrame:
    """(id, dim, value): population scaling by dimension, 0 where a dimension does not vary. Long form, one pass of sums."""
    long = df.select(id_col, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))
    stats = long.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return long.join(stats, "dim").select(id_col, "dim", F.when(F.col("std") == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("mean")) / F.col("std")).alias("value"))


def standardised(df: DataFrame, vector: str = "features") -> DataFrame:
    """Adds `scaled`, a vector column: means and deviations of all dimensions are one row."""
    n = df.select(F.size(vector).alias("d")).first()
    if n is None:
        return df.withColumn("scaled", array_to_vector(F.col(vector).cast("array<double>")))
    d = n.d
    v = F.col(vector).cast("array<double>")
    one = df.agg(*[F.avg(v[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(v[k]).alias(f"s{k}") for k in range(d)]).first()
    means, stds = [one[f"m{k}"] for k in range(d)], [one[f"s{k}"] or 0.0 for k in range(d)]
    values = F.array(*[F.lit(0.0) if s == 0 else (v[k] - F.lit(m)) / F.lit(s) for k, (m, s) in enumerate(zip(means, stds))])
    return df.withColumn("scaled", array_to_vector(values))


def principal_components(df: DataFrame, k: int, vector: str = "scaled") -> DataFrame:
    """Adds `pca` (vector) and `pca_1d`; of each component the loading of largest size is positive."""
    model = PCA(k=k, inputCol=vector, outputCol="raw_pca").fit(df)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    signs[signs == 0] = 1
    raw = vector_to_array("raw_pca")
    out = model.transform(df).withColumn("pca", array_to_vector(F.array(*[raw[i] * float(s) for i, s in enumerate(signs)]))).drop("raw_pca")
    return out.withColumn("pca_1d", vector_to_array("pca")[0])


def mixture(df: DataFrame, k: int, vector: str = "pca", seed: int = 42):
    """(df with `cluster`, model): full covariances."""
    model = GaussianMixture(k=k, featuresCol=vector, predictionCol="cluster", probabilityCol="probability", seed=seed, maxIter=50).fit(df)
    return model.transform(df).drop("probability"), model


def log_likelihood(df: DataFrame, model, vector: str = "pca") -> float:
    """Of the rows under the model's final parameters, summed by partition."""
    weights = np.log(np.maximum(model.weights, 1e-300))
    parts = []
    for g in model.gaussiansDF.collect():  # a row a cluster
        cov = g.cov.toArray() + 1e-9 * np.eye(g.cov.numRows)
        parts.append((g.mean.toArray(), np.linalg.inv(cov), -0.5 * (np.linalg.slogdet(cov)[1] + len(cov) * math.log(2 * math.pi))))

    def sums(frames):
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()) if len(frame) else np.zeros((0, len(parts[0][0])))
            logs = np.stack([w + c - 0.5 * np.einsum("ij,jk,ik->i", x - m, inv, x - m) for w, (m, inv, c) in zip(weights, parts)], 1)
            top = logs.max(1, keepdims=True) if len(x) else np.zeros((0, 1))
            yield pd.DataFrame({"s": [float((top[:, 0] + np.log(np.exp(logs - top).sum(1))).sum())]})

    return df.select(vector_to_array(vector).alias("v")).mapInPandas(sums, "s double").agg(F.sum("s")).first()[0]


def bic(df: DataFrame, model, k: int, vector: str = "pca") -> float:
    n, d = df.count(), len(model.gaussiansDF.first().mean)
    return -2 * log_likelihood(df, model, vector) + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n)


def select_by_bic(df: DataFrame, ks: Sequence[int] = range(2, 16), vector: str = "pca", seed: int = 42) -> DataFrame:
    """(k, bic, best): the lowest value, the lowest k on ties."""
    df = df.select(vector).cache()
    try:
        rows = [(k, bic(df, mixture(df, k, vector, seed)[1], k, vector)) for k in ks]
    finally:
        df.unpersist()
    best = min(rows, key=lambda r: (r[1], r[0]))[0]
    return df.sparkSession.createDataFrame([(k, float(b), k == best) for k, b in rows], "k int, bic double, best boolean")


#: Squared distances below this share of a row's squared length are worked out from differences, because products lose their digits.
CLOSE = 1e-4


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y by a product of matrices; where that is not exact (close or not finite), by differences."""
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    left, right = np.hstack([-2 * x, xx[:, None], np.ones((len(x), 1))]), np.hstack([y, np.ones((len(y), 1)), yy[:, None]])
    apart = left @ right.T
    least = xx * CLOSE
    for i in np.flatnonzero(~(np.isfinite(least) & (apart.min(1, initial=np.inf) >= least))):
        again = np.flatnonzero(~((apart[i] >= least[i]) & np.isfinite(apart[i])))
        apart[i, again] = ((x[i] - y[again]) ** 2).sum(1)
    return np.sqrt(apart, out=apart)


def silhouette(df: DataFrame, id_col: str, vector: str, label: str, block: int = 4_096) -> DataFrame:
    """(id, label, silhouette): exact Euclidean values.

    Every row has to be held against all others, but no vector is shuffled more than once: the vectors are written to the
    session's shared folder, dealt to tasks of about `block` rows, and each task streams the written table by. It holds its own
    rows, a batch of the others, and a sum for each of its rows and labels. Rows with a null id or label, or without a vector,
    are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v")).dropna()
    folder = scratch(spark, "silhouette")
    rows.sortWithinPartitions("label").write.parquet(folder)  # a batch has few labels
    rows = spark.read.schema(rows.schema).parquet(folder)
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row a cluster
    labels, counts = np.array([r.label for r in sizes], dtype=np.int64), np.array([r.n for r in sizes], dtype=np.float64)
    n = int(counts.sum())

    def sums(frames):
        for frame in frames:
            for places in np.array_split(np.arange(len(frame)), max(1, round(len(frame) / block))):
                if not len(places):
                    continue
                part = frame.iloc[places]
                x, totals = np.stack(part.v.to_numpy()), np.zeros((len(part), len(labels)))
                centre = np.nan_to_num(x.mean(0), posinf=0.0, neginf=0.0)  # shorter vectors, more digits
                x = x - centre
                for batch in written(folder):
                    own = batch.column("label").to_numpy()
                    y = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, x.shape[1]) - centre
                    order = np.argsort(own, kind="stable")
                    own, y = own[order], y[order]
                    edges = [*np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)]
                    at = np.searchsorted(labels, own[edges[:-1]])
                    for i in range(0, len(x), 128):
                        apart = distances(x[i : i + 128], y)
                        for k, begin, end in zip(at, edges, edges[1:]):
                            totals[i : i + 128, k] += apart[:, begin:end].sum(1)
                home = np.searchsorted(labels, part.label.to_numpy())
                every = np.arange(len(part))
                a = np.where(counts[home] > 1, totals[every, home] / np.maximum(counts[home] - 1, 1), np.nan)
                means = totals / counts
                means[every, home] = np.nan
                yield pd.DataFrame({"id": part.id.to_numpy(), "own": part.label.to_numpy(), "a": a, "b": np.fmin.reduce(means, axis=1)})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, own int, a double, b double"
    spread = rows.repartition(max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 64))))
    per = spread.mapInPandas(sums, schema)
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") == 0, F.lit(1.0)).otherwise(F.greatest("a", "b")))
    return per.select(F.col("id").alias(id_col), F.col("own").alias("label"), value.alias("silhouette"))


def written(folder: str, rows: int = 1_024):
    """Batches of a Parquet folder, read one after another."""
    filesystem, at = located(folder)
    for info in sorted(filesystem.get_file_info(fs.FileSelector(at)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as f:
                yield from (b for b in pq.ParquetFile(f).iter_batches(rows) if b.num_rows)


def select_by_silhouette(df: DataFrame, id_col: str, ks: Sequence[int] = range(4, 9), vector: str = "pca", seed: int = 42) -> DataFrame:
    """(k, silhouette, best): the highest mean, the lowest k on ties."""
    rows, df = [], df.select(id_col, vector).cache()
    try:
        for k in ks:
            labelled, _ = mixture(df, k, vector, seed)
            rows.append((k, float(silhouette(labelled.withColumn("__v", vector_to_array(vector)), id_col, "__v", "cluster").agg(F.avg("silhouette")).first()[0])))
    finally:
        df.unpersist()
    best = min(rows, key=lambda r: (-r[1], r[0]))[0]
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, best boolean")


def of_clusters(rows: DataFrame, wanted, cluster: str = "cluster") -> DataFrame:
    """Rows of the wanted clusters; null clusters are none."""
    return rows.filter(F.col(cluster).isin(*wanted))
