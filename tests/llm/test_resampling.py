import hashlib
import math
import re
import zlib

import numpy as np
from skymosaic.llm import resampling
from skymosaic.llm.common import Words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, targets, percent, least, buckets=10_000):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for count, texts in ((s, [x for _, x in docs]), (t, targets)):
        for x in texts:
            for f in features(x)[1]:
                count[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    rows = []
    for d, x in docs:
        n, found = features(x)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found) // max(len(found), 1)
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    vocab = ["Ab", "cé", "d", "efg", "ñandú", "9x", "日本", "w" * 70, "z" * 64, "y" * 63, "q" * 300]
    texts = [", ".join(rng.choice(vocab, rng.integers(0, 60))) for _ in range(n)]
    texts[3:6] = [None, "", " .\x00\n"]
    texts[7] = texts[8]
    texts[20] = "long words " * 60_000
    return texts


def test_composed_crcs_are_those_of_the_strings():
    shifts = resampling.Shifts()
    for text in corpus(1, 60):
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), lower=True, hashes=False, space=resampling._BREAK)
        got = [c for crc, whole in resampling.gram_crcs(words, shifts, 4) for c in crc[whole].tolist()]
        assert got == [zlib.crc32(f) for f in features(text, 4)[1]]


def test_shift_over_any_length():
    shifts = resampling.Shifts()
    sizes = np.array([0, 1, 63, 64, 65, 1000, 70_001])
    got = shifts.over(np.full(len(sizes), zlib.crc32(b"head"), np.uint32), sizes)
    want = [zlib.crc32(b"head" + b"x" * n) ^ zlib.crc32(b"x" * n) for n in sizes]
    assert got.tolist() == want


def test_equals_brute_force(spark):
    texts = corpus(2)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (9, texts[9]), (9, texts[9])]
    targets = [*texts[30:60], None, ""]
    df = spark.createDataFrame([(d, t, 1, "a") for d, t in docs], "doc_id long, text string, weight int, rank string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in targets], "text string"), percent=40, least_words=5)
    rows = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = brute(docs, targets, 40, 5)
    # rows of one id and score may change places
    plain = lambda rows: sorted((key(r[:4]) for r in rows))
    assert plain(rows) == plain(want)
    by_rank = lambda rows: [r[:4] for r in sorted((r for r in rows if r[4]), key=lambda r: r[4])]
    assert by_rank(rows) == by_rank(want)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, sum(r[4] is not None for r in want) + 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    (row,) = resampling.resample(some, none, percent=100, least_words=1).collect()
    assert (row.n_words, row.n_features, row.rank) == (3, 5, 1) and row.weight < 0
    assert resampling.resample(some, some).first()["rank"] is None


def test_ranks_of_many_equal_rows(spark):
    """A third of the rows are one row: they take ranks one after another, over several ranges."""
    rows = [(5, "same words here")] * 3000 + [(i, f"other words {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    weighed = resampling.weigh(df, df)
    got = resampling.draw(weighed, percent=100, least_words=1)
    ranks = got.select("rank", "score", "doc_id").orderBy("rank").collect()
    assert [r[0] for r in ranks] == list(range(1, 9001))
    assert [tuple(r)[1:] for r in ranks] == sorted((tuple(r)[1:] for r in ranks), key=lambda r: (-r[0], r[1]))
