"""Metadata tables in CSV and Parquet, label files, and pictures as binary columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import parse_lines

TILE_SCHEMA = "tile_filename string, source_tif string, col_off int, row_off int, tile_width int, tile_height int, src_width int, src_height int, crs string, transform string, tile_transform string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header names are trimmed; without a schema the types are inferred."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], append: bool = False) -> None:
    """Columns in the given order; appending adds files, so a header never repeats within one."""
    df.select(*columns).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def last_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of the greatest `order` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def split_of(path: Column) -> Column:
    """The folder after the first of a relative path: images/<split>/name."""
    return F.element_at(F.split(path, "/"), 2)


def corrected(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "../")


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, class_id, corners): a row a line. Empty files give no row: background comes from the tile table."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(stem(F.col("_metadata.file_path")).alias("stem"), "value")
    return files.select("stem", F.explode(parse_lines(F.col("value"))).alias("row")).select("stem", "row.*")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, stem, length) without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", stem(F.col("path")).alias("stem"), "length")


def paired(pictures: DataFrame, annotations: DataFrame, pattern: str = r"\.[^./\\]*$", replacement: str = ".geojson", path: str = "path") -> DataFrame:
    """(picture, annotation): pictures whose path, rewritten by a rule (another ending, another folder), is that of an annotation file.

    Both tables have a column `path`, such as `list_files` gives; pictures without a file, and files without a picture, go.
    """
    wanted = pictures.select(F.col(path).alias("picture"), F.regexp_replace(path, pattern, replacement).alias("annotation"))
    return wanted.join(annotations.select(F.col(path).alias("annotation")), "annotation").select("picture", "annotation")


def png_size(content: Column) -> Column:
    """struct<width,height> from a picture's first bytes; null for others."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def read_pictures(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray], glob: str = "*") -> DataFrame:
    """(stem, height, width, bands, samples, error): `decode` gives rows x columns x bands; a picture that fails keeps its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(stem(F.col("path")).alias("stem"), "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["stem"], frame["content"]):
                try:
                    x = decode(bytes(content))
                    x = x[:, :, None] if x.ndim == 2 else x
                    rows.append((name, *x.shape, x.astype(float).ravel(), None))
                except Exception as e:  # the file's fault: told in its row
                    rows.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["stem", "height", "width", "bands", "samples", "error"]).astype({"height": "Int32", "width": "Int32", "bands": "Int32"})

    return files.mapInPandas(work, "stem string, height int, width int, bands int, samples array<double>, error string")


def decode_npy(content: bytes) -> np.ndarray:
    import io

    return np.load(io.BytesIO(content), allow_pickle=False)
