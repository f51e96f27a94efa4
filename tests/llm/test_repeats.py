import hashlib
import re

import numpy as np
import pytest
from skymosaic.llm import repeats, substring_dedup, suffix_dedup

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute_words(rows, width):
    rows = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, width):
    rows = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - width + 1):
            k = w[i : i + width]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in rows:
        gone = np.zeros(len(w) + 2, bool)
        for i in range(len(w) - width + 1):
            if first[w[i : i + width]] < (d, i):
                gone[i + 1 : i + 1 + width] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        gone = gone[1:-1]
        out.append((d, len(w), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    vocab = ["ab", "cé", "d", "efg", "ñ", "hij", "kl", "mnop", "q", "日本"]
    passages = [" ".join(rng.choice(vocab, rng.integers(15, 60))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocab, rng.integers(0, 40))) for _ in range(3)]
        if rng.random() < 0.5:
            parts.insert(1, passages[int(rng.integers(0, 4))])
        if rng.random() < 0.2:
            parts.append(parts[0])
        rows.append((i, "\n".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1][:-5] + "xyz"), (n + 2, None), (n + 3, ""), (n + 4, "ab " * 400), (n + 5, "a" * 900), (n + 6, "ab " * 90), (n + 7, " ".join(rng.choice(vocab, 8_000)) + passages[0])]
    return rows + [rows[5], (7, passages[1] + " other text of the same id")]


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3)])
def test_words_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, spans int, doc int").repartition(5)
    got = sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(df, width=10, gram=3, hot=hot)).collect()))
    assert got == brute_words(rows, 10)


@pytest.mark.parametrize("seed,hot", [(3, 20_000), (4, 3)])
def test_bytes_equal_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2_000)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, spans int, doc int").repartition(5)
    got = sorted(map(tuple, suffix_dedup.digest(suffix_dedup.dedup(df, width=30, gram=8, hot=hot)).collect()))
    assert got == brute_bytes(rows, 30)


def test_null_ids_come_last_and_equal_hashes_decide_nothing(spark, monkeypatch):
    """With all hashes of runs equal, texts alone tell runs apart; a null id counts as the largest."""
    rows = corpus(5, 60)
    rows[10] = (None, rows[3][1])
    known = [(10**6 if d is None else d, t) for d, t in rows]
    real = repeats.runs
    monkeypatch.setattr(repeats, "runs", lambda *a: (*real(*a)[:5], real(*a)[5] * np.uint64(0)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((10**6 if r[0] is None else r[0], *r[1:]) for r in map(tuple, suffix_dedup.digest(suffix_dedup.dedup(df, width=30, gram=8)).collect()))
    assert got == brute_bytes(known, 30)
    got = sorted((10**6 if r[0] is None else r[0], *r[1:]) for r in map(tuple, substring_dedup.digest(substring_dedup.dedup(df, width=10, gram=3)).collect()))
    assert got == brute_words(known, 10)


def test_spans_of_very_many_documents():
    n = 9_000_000
    key, begin, end = repeats.merged(np.arange(n), np.full(n, 5), np.full(n, 70_000))
    assert len(key) == n and (begin == 5).all() and (end == 70_000).all()


def test_an_anchor_of_many_runs_stays_small():
    """20,000 different passages of one anchor: dealt by windows, `hot` of them at most meet in one automaton."""
    import tracemalloc

    rng = np.random.default_rng(6)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 5_000, 92)).encode() for _ in range(1_000)]
    tracemalloc.start()
    substring_dedup.covered(passages, np.arange(1_000), np.arange(1_000), np.zeros(1_000, np.int64), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(df).count() == 0 and suffix_dedup.dedup(df).count() == 0


def test_column_wise_sorting():
    rng = np.random.default_rng(8)
    strings = [bytes(rng.choice(list(b"abc"), rng.integers(0, 25)).tolist()) for _ in range(40)]
    name, offset, common = suffix_dedup.sort_columns(strings)
    expected = sorted((strings[i][o:] + b"\0" + bytes([i]), i, o) for i in range(40) for o in range(len(strings[i]) + 1))
    key = lambda s: [(c + 1) for c in s]
    expected = sorted(((key(strings[i][o:]) + [0, i]), i, o) for i in range(40) for o in range(len(strings[i]) + 1))
    assert [(i, o) for _, i, o in expected] == list(zip(name.tolist(), offset.tolist()))
    for (i, o), (k, p), c in zip(zip(name, offset), zip(name[1:], offset[1:]), common[1:]):
        a, b = strings[i][o:], strings[k][p:]
        n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert n == c


def test_automaton_finds_first_owner():
    rng = np.random.default_rng(9)
    texts = [rng.choice(list("abc"), 30).tolist() for _ in range(6)]
    automaton = substring_dedup.SuffixAutomaton()
    for i, t in enumerate(texts):
        automaton.add(t, i)
    for t in texts:
        found = dict(automaton.matches(t, 4))
        for e in range(4, 31):
            assert found[e] == next(i for i, u in enumerate(texts) if any(u[s : s + 4] == t[e - 4 : e] for s in range(27)))
