"""Candidates of any length are measured."""

import random

from skymosaic.llm import secret_scan


def test_long_strings_are_reported(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = ["".join(rng.choice(alphabet) for _ in range(n)) + "7q" for n in (250, 255, 1_000, 20_000)]
    rows = [(i, f"auth header {x} sent") for i, x in enumerate(made)] + [(9, "auth header " + "z1" * 5_000)]
    found = {r.doc_id: [(x.kind, x.value) for x in r.findings] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), dictionary=b"default user").collect()}
    assert [found[i] for i in range(4)] == [[("novel", x)] for x in made] and found[9] == []
