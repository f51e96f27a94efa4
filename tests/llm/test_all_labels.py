"""Toxicity is learnt from every labelled row of the training fold, whether ids are broadcast or joined."""

import pytest
from pyspark.sql import functions as F

from skymosaic.llm import toxicity
from skymosaic.llm.common import fold


@pytest.mark.parametrize("most", [toxicity.BROADCAST, 1_000])
def test_every_labelled_row_is_read(spark, most):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    rows = toxicity.labelled_rows(docs, labels.unionAll(labels), "doc_id", "text", "toxic", 3, 1, most)
    wanted = labels.filter(fold("doc_id", 3) != 1)
    assert rows.count() == rows.distinct().count() == wanted.count() > 24_000
    assert rows.agg(F.sum("__label")).first()[0] == wanted.agg(F.sum("toxic")).first()[0]
