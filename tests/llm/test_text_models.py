import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from skymosaic.llm import lm_scoring, mixing, quality, toxicity

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        words = ["the", "of", "Cat", "dog", "runs", "fast"] if i % 2 else ["le", "chat", "noir", "é", "vite"]
        text = " ".join(rng.choice(words, rng.integers(0, 60)).tolist() + [f"rare{i}"] * (i % 3))
        rows.append((i, text, "en" if i % 2 else None, f"s{i % 3}" if i % 10 else None, 1))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, "x " * 60_000, "en", "s1", 0), (5, "repeated id", "en", "s1", 0), (303, "\n\t  ", "fr", "s9", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def test_lm_counts_base_and_gain(docs):
    rows = docs.collect()
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [" "]
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    c = Counter(w for r in rows if not held[r.doc_id] for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    expected = sorted((r.doc_id, held[r.doc_id], len(t := tokens(r.text)), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in t), 6)) for r in rows)
    for head in (lm_scoring.HEAD, 3):
        lm_scoring.HEAD, before = head, lm_scoring.HEAD
        try:
            got = lm_scoring.score(docs).collect()
        finally:
            lm_scoring.HEAD = before
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_lm_is_a_distribution(spark, docs):
    """Parts of all classes sum to one in every context, and the words of a part with its unknown slot to one."""
    training = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = lm_scoring.count_words(training)
    model, denominator = lm_scoring.trained(training, vocabulary, vocabulary.agg(F.sum("c")).first()[0])
    raw = b"a cat runs"
    s = lm_scoring.Stream(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    total = np.zeros(s.total)
    for k in range(lm_scoring.CLASSES):
        for part in range(lm_scoring.SUBCLASSES):
            # a form that leads to this part, made up where no word has it
            model.top[0], model.sub[0] = k, part
            s.form[:] = 0
            total += np.exp(model.log_prob(s))
    assert s.total == 4 and np.allclose(total, 1, atol=1e-4)
    model, denominator = lm_scoring.trained(training, vocabulary, 0)
    mass = Counter()
    for r in vocabulary.collect():
        w = np.frombuffer(r.word.encode(), np.uint8)
        form = np.array([lm_scoring.FORMS]) if r.word == " " else lm_scoring.forms(w, np.array([0]), np.array([len(w)]))
        leaf = int(model.leaf(form)[0])
        mass[leaf] += (r.c + 1) / 10 ** denominator[leaf]
    assert all(abs(m + 10 ** -denominator[leaf] - 1) < 1e-9 for leaf, m in mass.items())


def test_lm_gain_and_partitions(spark):
    """Held-out documents of sf0.1: 0.15 log10 a token over the base at least; other partitions move the score little, nothing else."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path).select("doc_id", "text")
    one, two = ({r.doc_id: r for r in lm_scoring.score(docs.repartition(n, "doc_id")).collect()} for n in (4, 7))
    held = [r for r in one.values() if r.held_out]
    gain = lambda rows: sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain(held) > 0.15 and abs(gain(held) - gain([two[r.doc_id] for r in held])) < 0.02
    assert all(abs(r.base_score - two[d].base_score) < 1e-6 * max(1, abs(r.base_score)) and r[:5] == two[d][:5] for d, r in one.items())


def test_disguises_are_decoded():
    words = "stupid idiot loser moron the house water summer bottle garden pathetic" .split()
    three = Counter(x for w in words for w in [f"^^{w}$"] for i in range(len(w) - 2) for x in [w[i : i + 3]])
    model = toxicity.Characters(three)
    for disguised, plain in (("st0p1d".replace("0", "u"), "stupid"), ("1d10t", "idiot"), ("l0$er", "loser"), ("m.o.r.o.n", "moron"), ("stuuupiiid", "stupid"), ("p@th3t1c", "pathetic"), ("i*d*i*o*t", "idiot")):
        assert plain in toxicity.restored(disguised, model), disguised
    assert toxicity.restored("summer", model) == ["summer"]
    assert any("idiot" in toxicity.restored(w, model) for w in toxicity.words_of("you i d i o t !"))


def test_spaced_runs_are_parted_and_long_words_decoded():
    words = "a you what stupid idiot loser moron the house water summer bottle garden pathetic today".split()
    three = Counter(x for w in words for w in [f"^^{w}$"] for i in range(len(w) - 2) for x in [w[i : i + 3]])
    model = toxicity.Characters(three)
    found = lambda text: {x for w in toxicity.words_of(text) for x in toxicity.restored(w, model)}
    assert {"what", "a", "moron", "today"} <= found("what a m o r o n today")
    assert {"you", "idiot"} <= found("y o u i d i o t")
    assert {"idiot", "moron"} <= found("i d i o t m o r o n")
    assert {"stupid", "idiot"} <= found("s t u p ! d  1 d 1 0 t")
    assert {"moron", "idiot"} <= found("m.o.r.o.n i-d-i-o-t")
    assert {"garden", "loser"} <= found(" ".join("garden" * 60 + "loser"))
    assert "idiot" in found("idi" + "o" * 70 + "t") and "moron" in found("m" + "." * 90 + "oron")
    # all of a word longer than a window is decoded
    assert toxicity.restored("l0ser" * 200, model)[0] == "loser" * 200


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(6)
    plain = ["garden", "water", "bottle", "summer", "the", "of", "house"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(plain, rng.integers(1, 30)).tolist()
        toxic = i % 5 == 0
        held = zlib.crc32(str(i).encode()) % 3 == 1
        if toxic:
            bad = str(rng.choice(["idiot", "moron"]))
            words.insert(int(rng.integers(0, len(words) + 1)), {"idiot": "1d!ot", "moron": "m o r o n"}[bad] if held else bad)
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(toxic)))
    rows += [(600, None, "x", 0.1), (601, "", "x", 0.1), (602, "water " * 50_000, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    lab = spark.createDataFrame([*labels, (700, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, lab).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == t for i, t in labels)
    assert not any(got[i].predicted for i in (600, 601, 602))
    assert toxicity.score(docs.limit(0), lab).count() == 0
    assert {r.predicted for r in toxicity.score(docs, lab.limit(0)).collect()} == {0}


def test_quality_shrinks_and_keeps(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        words = [f"w{x}" for x in rng.integers(0, 500, 40)] if good else ["SPAM!!"] * 40
        rows.append((i, " ".join(words), "en", f"h{i % 2}", 0.0))
        labels.append((i, int(good)))
    rows += [(400, None, None, None, 0.0), (401, "", "en", "lone", 0.0), (402, " ".join(f"w{x}" for x in range(30_000)), "en", "h1", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, own double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, lab).collect()}
    assert len(got) == 403
    assert np.mean([got[i].kept == bool(q) for i, q in labels]) > 0.98
    # without its own evidence the only document of a host has the global mean
    assert abs(got[401].host_mean - np.mean([r.own for r in got.values()])) < 1e-9
    assert quality.classify(docs.limit(0), lab).count() == 0
    assert all(r.kept for r in quality.classify(docs, lab.limit(0)).collect())


def plain_measures(text):
    """The measures, written by their meaning."""
    raw, words = text.encode(), WORD.findall(text)
    n, size = max(len(words), 1), max(len(raw), 1)
    among = lambda letters, by: sum(c in letters for c in raw) / by
    capitals, small = range(65, 91), range(97, 123)
    return [
        math.log1p(len(words)), sum(len(w.encode()) for w in words) / n, len(set(words)) / n * math.log1p(n), sum(c in capitals or c in small or c >= 128 for c in raw) / size, among(capitals, size), among(range(48, 58), size),
        among(b".,;:?", n), among(b"!", n), among(b"*$#@&%^~|<>{}[]=_+\\/", n), among(b"\n", n), sum(a == b for a, b in zip(words, words[1:])) / n, among(b"eE", size),
    ]


def test_quality_equals_plain_python(spark):
    """300 rows: measures, posteriors without the document's own evidence, and scores, in plain loops."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < (0.9 if i % 3 else 0.4)
        text = " ".join(rng.choice(["Ab", "cé", "dEf", "x9", "y!", "#z", "e"] if good else ["BUY", "$$$", "now!!", "now!!"], rng.integers(0, 40)))
        rows.append((i, text, ["en", "fr", None][i % 3], [None, "a", "b", "c"][int(rng.integers(0, 4))]))
        labels.append((i, int(good)))
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([plain_measures(t) for _, t, _, _ in rows])
    taught = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality.Additive(x[taught], np.array([labels[i][1] for i in taught], float))
    own = []
    for row in x:
        z = model.weights[0] + sum(model.weights[1 + sum(len(k) + 1 for k in model.knots[:m]) + sum(v >= k for k in knots)] for m, (v, knots) in enumerate(zip(row, model.knots)))
        own.append(1 / (1 + math.exp(-min(max(z, -12), 12))))
    hosts, paths = {}, {}
    for p, (_, _, lang, source) in zip(own, rows):
        hosts.setdefault(source, []).append(p)
        paths.setdefault((source, lang), []).append(p)
    mean = sum(own) / 300
    within = sum(sum((p - sum(g) / len(g)) ** 2 for p in g) for g in paths.values()) / (300 - len(paths))
    between = lambda groups, k, over: max((max(sum(sum(g) ** 2 / len(g) for g in groups.values()) - over, 0) - (k - 1) * within) / 300, within * 1e-4)
    host_strength = within / between(hosts, len(hosts), sum(own) ** 2 / 300)
    path_strength = within / between(paths, len(paths) - len(hosts) + 1, sum(sum(g) ** 2 / len(g) for g in hosts.values()))
    for (i, _, lang, source), p in zip(rows, own):
        h, g = hosts[source], paths[source, lang]
        host = (sum(h) - p + host_strength * mean) / (len(h) - 1 + host_strength)
        path = (sum(g) - p + path_strength * host) / (len(g) - 1 + path_strength)
        inside = lambda v: min(max(v, 1e-4), 1 - 1e-4)
        odds = inside(p) / (1 - inside(p)) * inside(path) / (1 - inside(path)) / (mean / (1 - mean))
        r = got[i]
        assert np.allclose([r.own, r.host_mean, r.path_mean, r.score], [p, host, path, odds / (1 + odds)], atol=1e-6)
        assert r.kept == (r.score >= 0.5) and r.held_out == (i not in taught)


def test_toxicity_equals_plain_python(spark):
    """300 rows: learning and scoring in plain loops over the restored words."""
    rng = np.random.default_rng(9)
    plain = ["house", "water", "summer", "bottle", "garden", "moroccan"]
    rows = []
    for i in range(300):
        words = rng.choice(plain, 12).tolist()
        if i % 5 == 0:
            words.insert(3, str(rng.choice(["idiot", "1d1ot", "m o r o n", "moron"])))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    three, words = Counter(), Counter()
    for _, t, _ in taught:
        for w in set(t.split()):
            if w.isalpha():
                words[w] += 1
                three.update([f"^^{w}$"[k : k + 3] for k in range(len(w) + 1)])
    model = toxicity.Characters({k: n for k, n in three.items() if n >= 4}, {k: n for k, n in words.items() if n >= 4})
    features = lambda t: {f for w in toxicity.words_of(t) for x in toxicity.restored(w, model) if x for f in ["w:" + x, *["p:" + x[:k] for k in (4, 5, 6) if len(x) >= k]]}
    bad, fine = Counter(), Counter()
    for _, t, y in taught:
        (bad if y else fine).update(features(t))
    prior = sum(y for _, _, y in taught) / len(taught)
    shares = {}
    for f, n in bad.items():
        doubt, least = (2, 0.6) if f[0] == "w" else (10, 0.9)
        share = (n + doubt * prior) / (n + fine[f] + doubt)
        if n >= 4 and n >= 0.6 * (n + fine[f]) and share >= least:
            shares[f] = share
    for i, t, _ in rows:
        apart = 1.0
        for x in sorted({x for w in toxicity.words_of(t) for x in toxicity.restored(w, model)}):
            known = [shares[f] for f in toxicity.features(x) if f in shares]
            apart *= 1 - max(known, default=0.0)
        expected = max(prior * 0.1, 1 - apart)
        assert abs(got[i].score - expected) < 1e-9 and got[i].predicted == (expected >= 0.7)


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(docs):
    big = docs
    got = mixing.mix(big, block=32).collect()
    rows = big.collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(dict(sizes))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id != 5:
            assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
            taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * 32 + 2
    again = mixing.mix(big.repartition(3), block=32).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0
