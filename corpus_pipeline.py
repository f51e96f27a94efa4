"""Training-data pipeline over `documents`: quality filter, near-duplicate join, substring removal, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymosaic.llm import byte_bpe, mixing, ngram_join, quality, suffix_dedup
from skymosaic.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_keys(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose id, null or not, and text hash are in `kept` (doc_id, text_key)."""
    keys = kept.select(F.col("doc_id").alias("__kept"), F.col("text_key").alias("__text")).distinct()
    same = docs.doc_id.eqNullSafe(keys["__kept"]) & (F.xxhash64(docs.text) == keys["__text"])
    return docs.join(keys, same, "left_semi").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: rows whose id it keeps; of rows with one id and different texts, those it keeps.

    An empty table gives an empty table; ties at the threshold stay; repeated rows stay repeated; other columns go.
    """
    found = quality.classify(docs.withColumn("text_key", F.xxhash64("text")), table(spark, sf_dir, "labels"), carry=("text_key",))
    return with_keys(docs, found.filter("kept"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; a repeated row stays once.

    Texts without words have no group and stay; of a group of null ids only, each different text stays. An empty table
    gives an empty table; other columns go.
    """
    return with_keys(docs, ngram_join.join(docs).filter("kept")).dropDuplicates(["doc_id", "text"])


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that start earlier in the collection; n_chars counts what is left.

    Bytes of a character that a cut leaves incomplete go with the cut. Texts of which nothing is left go; texts that were
    empty or null stay, as empty ones. Equal rows keep each other's bytes. An empty table gives an empty table; other
    columns go.
    """
    removed = suffix_dedup.dedup(docs, carry=("lang", "source"))
    whole, mended = F.try_validate_utf8(F.col("kept").cast("string")), F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("n_removed") == 0, whole).otherwise(F.coalesce(whole, F.replace(mended, F.lit("\ufffd"), F.lit(""))))
    left = removed.withColumn("text", text).filter("text <> '' or n_removed = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of words that the mix takes, each as a document with the id it comes from; n_chars counts its characters.

    A document that is taken once as a whole stays as it is; one taken twice comes twice. Texts without words take nothing
    and go. An empty table gives an empty table; other columns go.
    """
    return mixing.mixed_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (null: empty), and proof that they decode to it; one row for each of `docs`, none for an empty table."""
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return byte_bpe.digest(encoded)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", remove_repeated_strings),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]

#: The stages cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
