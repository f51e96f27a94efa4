"""Incremental runs: what is new against a table, and the same over file streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def not_yet(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(done.select(*keys), list(keys), "left_anti")


def with_files(rows: DataFrame, folder: str, path: str, there: bool = True) -> DataFrame:
    """Rows whose file (`path`, relative to a folder) lies in the folder; with `there` false, those whose file does not.

    The folder is listed by Spark's reader, without reading any file; a folder that is not there holds nothing.
    """
    spark = rows.sparkSession
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("__path"))
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)).toString()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows.limit(0) if there else rows
    names = listed.select(F.expr(f"substring(__path, {len(root.rstrip('/')) + 2})").alias("__name"))
    return rows.join(names, F.regexp_replace(F.col(path), r"^\./", "") == F.col("__name"), "left_semi" if there else "left_anti")


def read_folder(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_a_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_of_each(stream: DataFrame, keys: Sequence[str], time: str | None = None, late: str = "30 days") -> DataFrame:
    """One row of each key; with a time column the state of keys older than `late` is let go."""
    if not time:
        return stream.dropDuplicates(list(keys))
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run_to_end(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs the stream over all that is there now into Parquet, exactly once, and gives what the sink holds.

    The sink and the stream's own checkpoint lie in `folder`, else in the session's checkpoint folder.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def upsert_new(stream: DataFrame, table: str, keys: Sequence[str], checkpoint: str):
    """A running query that adds to a Parquet folder those rows of each batch whose keys it does not hold."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        try:
            held = batch.sparkSession.read.parquet(table)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = not_yet(fresh, held, keys)
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
