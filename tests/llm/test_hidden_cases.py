"""Texts that once hung an operator or met another text's hash."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from skymosaic.llm import lm_scoring, mixing, ngram_join, substring_dedup, suffix_dedup, toxicity
from skymosaic.llm.common import Words


def thue_morse(n, a="a", b="b"):
    """Two different words whose polynomial hashes modulo 2^64 are equal for any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("text", ["sign: " + "_" * 60 + "(name)", "a" + "=" * 100_000 + "a", "a* " * 30_000 + "zz", "a-" * 50_000 + "zz", "_ " * 50_000, "." * 100_000 + "a"])
def test_words_are_found_in_linear_time(text):
    begin = time.process_time()
    words = toxicity.words_of(text)
    for w in words:
        toxicity.edged(w)
    assert time.process_time() - begin < 0.5


def test_spaced_runs_are_cut_back_to_a_valid_end():
    assert list(toxicity.spaced_runs("say i d i o t now")) == ["i d i o t"]
    assert list(toxicity.spaced_runs("i.d.i.o.t!")) == ["i.d.i.o.t"]
    assert list(toxicity.spaced_runs("a b c d e-fg")) == ["a b c d"]
    assert list(toxicity.spaced_runs("a b c d-ef")) == []
    assert list(toxicity.spaced_runs("x_y_z_w end")) == ["x_y_z_w"]
    assert list(toxicity.spaced_runs("____________")) == []


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_of_one_pattern_stay_apart(spark, n):
    one, other = thue_morse(n)
    w = Words(np.frombuffer(f"{one} {other} {one}".encode(), np.uint8), np.array([0, 3 * n + 2]))
    assert w.hash[0] == w.hash[2] != w.hash[1]
    df = spark.createDataFrame([(0, one), (1, other), (2, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in ngram_join.join(df).collect()) == [(0, 1, 0), (1, 0, 1), (2, 1, 0)]
    pad = " ".join(f"w{i}" for i in range(9))
    df = spark.createDataFrame([(0, f"{pad} {one}"), (1, f"{pad} {other}"), (2, f"{pad} {one}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.digest(substring_dedup.dedup(df, width=10, gram=3)).collect()) == [(0, 0), (1, 0), (2, 10)]


def test_scoring_knows_only_words_it_saw(spark):
    one, other = thue_morse(1024)
    train = [d for d in range(40) if __import__("zlib").crc32(str(d).encode()) % 7 != 2]
    held = next(d for d in range(40) if __import__("zlib").crc32(str(d).encode()) % 7 == 2)
    rows = [(d, f"some words {one}") for d in train] + [(held, other)]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held].n_known == 1 and got[train[0]].n_known == 4


def test_rows_of_one_id_and_one_32_bit_hash(spark):
    """Of two texts of one id whose short hashes are equal, only what repeats goes."""
    texts = spark.range(300_000).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("t")).withColumn("h", F.hash("t"))
    pair = texts.groupBy("h").agg(F.collect_list("t").alias("ts")).filter("size(ts) > 1").first().ts[:2]
    df = spark.createDataFrame([(0, pair[0]), (5, pair[0]), (5, pair[1])], "doc_id long, text string")
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.dedup(df, width=200)).collect())
    assert got == sorted([(0, 0, whole(pair[0])), (5, 256, whole("")), (5, 0, whole(pair[1]))])


def test_small_sources_reach_their_targets(spark):
    rows = [(i, " ".join(["w"] * 10), f"s{i % 60:02d}") for i in range(600)] + [(1000 + i, " ".join(["w"] * 1000), "large") for i in range(300)]
    rows += [(5000, "one two three", "tiny"), (5001, "one", "least"), (5002, "", "none"), (5003, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id")
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert len(by) == 65
    for r in by:
        assert abs(r.taken - r.target) <= max(1.0, 0.05 * r.target) and r.over <= 0


def test_many_equal_rows_are_laid_down_one_by_one(spark):
    df = spark.createDataFrame([(7, "a b c", "s")] * 9_000 + [(8, "d", "s")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 9_001 and all(r.taken <= 6 for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * 27_001) <= 400
