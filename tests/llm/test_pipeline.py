import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from skymosaic.llm import byte_bpe, mixing

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def test_stages_over_a_small_table(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [f"word{i}é" for i in range(3_000)]
    passage = " ".join(rng.choice(words, 60))
    rows, labels = [], []
    for i in range(200):
        if i % 5 == 0:
            rows.append((i, "BUY!! " * 60, "en", f"s{i % 2}", 0))
            labels.append((i, 0))
            continue
        text = " ".join(rng.choice(words, 120))
        if i % 7 == 0:
            text = f"{text} {passage}"
        rows.append((i, text, "en", f"s{i % 2}", 0))
        labels.append((i, 1))
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, rows[2][1] + " end", "en", "s1", 0), rows[3], (1002, None, None, None, None), (None, rows[4][1] + " x", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    good = {i for i, q in labels if q}
    assert good <= {r.doc_id for r in seen[0]} and not {i for i, q in labels if not q} & {r.doc_id for r in seen[0]}
    ids = [r.doc_id for r in seen[1]]
    assert good <= set(ids) and len(ids) == len(set(ids)) and not {1000, 1001, None} & set(ids)
    with_passage = [r for r in seen[2] if passage[:200] in r.text]
    assert [r.doc_id for r in with_passage] == [7]
    assert all(r.n_chars == len(r.text) for r in seen[2] if r.text)
    words = lambda r: WORD.findall(r.text or "")
    sizes, mixed = Counter(), Counter()
    for r in seen[2]:
        sizes[r.source] += len(words(r))
    for r in seen[3]:
        mixed[r.source] += len(words(r))
    want = mixing.targets([(s, sizes[s]) for s in sorted(sizes, key=lambda s: (s is None, s))])
    assert all(abs(mixed[s] - want[s]) <= 4 * mixing.BLOCK for s in sizes)
    # spans of the texts, each text no more than twice
    texts = {r.doc_id: r for r in seen[2]}
    per_doc = Counter()
    for r in seen[3]:
        assert r.text in texts[r.doc_id].text and r.n_chars == len(r.text) and r.source == texts[r.doc_id].source
        per_doc[r.doc_id] += len(words(r))
    assert all(n <= 2 * len(words(texts[d])) for d, n in per_doc.items())
    assert sum(r.text == texts[r.doc_id].text for r in seen[3]) > len(seen[3]) / 2
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r.doc_id, r.n_tokens) for r in seen[4]) == sorted((r.doc_id, len(own.encode_ordinary(r.text))) for r in seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_spans_in_layers():
    assert mixing.runs_taken([]) == []
    assert mixing.runs_taken([(0, 5, 1), (5, 5, 2), (10, 5, 1)]) == [(0, 15), (5, 10)]
    assert mixing.runs_taken([(10, 5, 2), (0, 5, 2), (20, 1, 0)]) == [(0, 5), (10, 15), (0, 5), (10, 15)]


def test_mixed_texts_take_what_mix_says(spark):
    rng = np.random.default_rng(12)
    rows = [(i, "  " + "\t".join(f"é{x}" for x in rng.integers(0, 99, rng.integers(0, 90))) + "\n", ["a", "b", None][i % 3], i) for i in range(120)]
    rows += [rows[4], (4, "other text of one id", "a", 5), (None, "no id at all", "b", 6), (500, None, "a", 7), (501, "", "a", 8), (502, "w " * 5_000, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    spans = mixing.mixed_texts(docs, block=16)
    assert spans.columns == docs.columns
    got, taken = Counter(), Counter()
    for r in spans.collect():
        assert any(r.text in (t or "") and (d, s, k) == (r.doc_id, r.source, r.times) for d, t, s, k in rows)
        got[r.doc_id] += len(WORD.findall(r.text))
    for r in mixing.mix(docs, block=16).collect():
        taken[r.doc_id] += r.taken
    assert {d: n for d, n in taken.items() if n} == dict(got)
    assert mixing.mixed_texts(docs.limit(0)).count() == 0


def test_stages_of_empty_tables_and_extra_columns(spark, tmp_path):
    text = " ".join(f"w{x}" for x in range(80))
    rows = [(1, text, "en", "a", 1, "x", 1, 0.5), (2, text, "en", "a", 1, "y", 2, 0.5), (3, "one two three", None, None, None, None, None, None)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_key string, size int, kept double")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, str(tmp_path))
        assert k == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
        found = sorted(out.collect(), key=lambda r: r.doc_id)
        assert {r.doc_id for r in found} <= {1, 2, 3} and found
        if k == 1:
            assert [r.doc_id for r in found] == [1, 3]
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
