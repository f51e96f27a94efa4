import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from skymosaic.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def fold(levels, i, digest, arity):
    proof = ""
    for nodes in levels[:-1]:
        b = i // arity * arity
        run = nodes[b : b + arity]
        proof += "".join(run[: i - b]) + "".join(run[i - b + 1 :])
        digest = h([*run[: i - b], digest, *run[i - b + 1 :]])
        i //= arity
    return digest, proof


def brute(rows, arity=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, told(r)))
    trees = [tree([told(r) for r in groups[x]], arity) for x in langs]
    top = tree([t[-1][0] for t in trees], arity)
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            sent = told((*r[:4], r[4].translate(LOWER) if bad and r[4] is not None else r[4]))
            subroot, below = fold(trees[k], i, sent, arity)
            root, above = fold(top, k, subroot, arity)
            out.append((r[0], told(r), trees[k][-1][0], top[-1][0], h([below, above]), root, root == top[-1][0]))
    return out


def rows_of(n, seed, langs):
    rng = np.random.default_rng(seed)
    rows = [(int(i), f"s{i % 3}", langs[int(rng.integers(len(langs)))], int(rng.integers(1000)), f"Text É {i}" * int(rng.integers(1, 5))) for i in rng.permutation(n)]
    return rows + [(n, None, None, None, None), (n + 1, "", "", 0, ""), (3, "s", langs[0], 1, "Another of id 3"), (None, "s", langs[0], 1, "No Id"), (None, "s", "only", 1, "no id"), rows[0], rows[0], (n + 2, "s", langs[0], 1, "Long " * 100_000)]


@pytest.mark.parametrize("n,langs,arity,size,fan", [(700, ["en", "de", "é", None], 8, 60, 3), (90, ["en"], 8, 1, 2), (500, [f"l{k}" for k in range(120)], 8, 40, 32), (300, ["a", "b"], 3, 10, 2), (5, ["x"], 8, 200_000, 32)])
def test_equals_brute_force(spark, n, langs, arity, size, fan):
    rows = rows_of(n, n, langs)
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string, place int").repartition(4)
    got = merkle.manifest(df, arity=arity, rows=size, fan=fan).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, arity), key=key)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 200, 511, 513])
def test_fragments_merge_in_any_order(n):
    """However leaves are cut into ranges and fragments are joined, one root is left, that of the plain tree."""
    rng = np.random.default_rng(n)
    digests = [h([str(i)]) for i in range(n)]
    cuts = [0, *sorted(set(rng.integers(0, n + 1, 6).tolist())), n]
    left = []
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            left.append([{"tree": "t", "total": n, "level": level, "index": i, "digest": d} for level, i, d, state in merkle.climb(a, digests[a:b], n, 8) if state != "closed"])
            assert len(left[-1]) <= 14 * 4
    while len(left) > 1:
        i, j = sorted(rng.choice(len(left), 2, replace=False).tolist())
        other = left.pop(j)
        left[i] = [{k: x[k] for k in ("tree", "total", "level", "index", "digest")} for x in merkle.merge(left[i] + other, 8) if x["state"] != "closed"]
    (root,) = left[0]
    assert root["digest"] == tree(digests, 8)[-1][0]
