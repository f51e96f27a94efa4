import os
import re
from collections import Counter

import numpy as np
import pytest
from skymosaic.llm import ngram_join as N

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    comp = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([comp[i], *[comp[j] for j in links[i]]])
            changed |= m != comp[i]
            comp[i] = m
    return sorted((rows[i][0], len(links[i]), comp[i], comp[i] == rows[i][0]) for i in range(n))


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows = []
    base = [rng.choice(5_000, rng.integers(30, 200)).tolist() for _ in range(25)]
    for i in range(260):
        words = list(base[i % 25])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, len(words)))] = int(rng.integers(10_000, 20_000))
        rows.append((i, " ".join(f"w{x}" for x in words)))
    rows += [(260, None), (261, ""), (262, "one two"), (263, "one two"), (264, "two one"), (265, " \n"), (266, rows[0][1]), (267, rows[0][1].replace(" ", "\n")), (268, "x " * 300), (269, "x " * 90)]
    rows.append((270, " ".join(f"u{x}" for x in range(20_000))))
    rows.append((271, " ".join(f"u{x}" for x in range(19_000))))
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "COLUMNS", 512)
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, rep string").repartition(3)
    assert sorted(map(tuple, N.join(df).drop("text_key").collect())) == brute(rows)


def test_rows_with_one_id_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (2, "g h i j k l"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_links) for r in N.join(df).collect())
    assert got == [(1, 1), (1, 2), (1, 2), (2, 1), (99, 2)]
    same = " ".join(f"a{x}" for x in range(40))
    df = spark.createDataFrame([(1, same), (1, "g h i j k l"), (3, same + " more"), (4, "g h i j k l")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in N.join(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (3, 1, 1), (4, 1, 1)]
    assert N.join(df.limit(0)).count() == 0


def test_null_ids(spark):
    same = " ".join(f"a{x}" for x in range(40))
    rows = [(None, same), (None, "g h i j k l"), (3, same + " more"), (None, "p q r s t u"), (None, "p q r s t u"), (None, None), (4, "")]
    got = sorted(((r.doc_id or 99, r.n_links, r.component_id or 99, r.kept) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(3, 1, 3, True), (4, 0, 4, True), (99, 0, 99, True), (99, 0, 99, True), (99, 1, 3, False), (99, 1, 99, True), (99, 1, 99, True)]


def test_prefixes_shorten_until_recall():
    assert N.prefix_length(0.8, 0.5) == 8 and N.prefix_length(0.8, 0.9999) in (4, 5)
    for p in (0.99, 0.999, 0.9999):
        k = N.prefix_length(0.8, p)
        assert 1 - (1 - 0.8**k) ** N.TREES >= p


@pytest.mark.parametrize("changed,expected", [(1, [8]), (4, [8, 5])])
def test_matching_shortens_only_while_pairs_need_it(spark, monkeypatch, changed, expected):
    """Pairs of one change in 200 words are found at whole keys; pairs near the threshold ask for shorter prefixes."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(30):
        words = rng.integers(0, 10**6, 200).astype(str).tolist()
        rows.append((2 * i, " ".join(words)))
        for x in range(changed):
            words[20 * x + 5] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    tried = []
    real = N.connected_components
    monkeypatch.setattr(N, "connected_components", lambda e, a, b: (tried.append(b), real(e, a, b))[1])
    got = N.join(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key").collect()
    assert sorted(map(tuple, got)) == brute(rows) and tried.count("least") == len(expected)


@pytest.mark.parametrize("most", [1 << 27, 64])
def test_wanted_documents_by_map_or_join(spark, monkeypatch, most):
    monkeypatch.setattr(N, "MOST_BITS", most)
    rows = corpus(3)
    assert sorted(map(tuple, N.join(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key").collect())) == brute(rows)


def test_recall_against_brute_force(spark):
    """Documents of sf0.1 whose id is divisible by 50 against all others, by an inverted index of shingles."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    got = {r.doc_id: r.n_links for r in N.join(docs).collect()}
    sets, holders = {}, {}
    for r in docs.select("doc_id", "text").collect():
        w = WORD.findall(r.text or "")
        sets[r.doc_id] = s = {hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else {hash(("short", *w))} if w else set()
        for x in s:
            holders.setdefault(x, []).append(r.doc_id)
    true = found = 0
    for d in (d for d in sets if d % 50 == 0):
        common = Counter(o for x in sets[d] for o in holders[x] if o != d)
        n = sum(5 * c >= 4 * (len(sets[d]) + len(sets[o]) - c) for o, c in common.items())
        true, found = true + n, found + got[d]
        assert got[d] <= n
    assert true and found / true >= 0.99
