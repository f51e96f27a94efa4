import numpy as np
import pytest
from skymosaic.llm import embedding_dedup as E
from skymosaic.llm.components import connected_components


def brute(rows, t=0.93):
    n = len(rows)
    x = [None if r[1] is None or r[2] is None or not len(r[1]) or any(c is None or not np.isfinite(c) for c in r[1]) or not any(r[1]) else np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows]
    links = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and rows[i][2] == rows[j][2] and x[i] @ x[j] >= t] for i in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([comp[i], *[comp[j] for j in links[i]]])
            if m != comp[i]:
                comp[i], changed = m, True
    return {rows[i][0]: (len(links[i]), rows[comp[i]][0]) for i in range(n)}


@pytest.mark.parametrize("per_cell,block", [(4096, 2048), (40, 16)])
def test_equals_brute_force(spark, per_cell, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "WIDE", 4 * block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        v = base[i % 60] + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.35, 1.0])
        rows.append((i, [float(c) for c in v], int(i % 2)))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] + [0.0] * 14, 1), (403, [float("nan")] * 16, 0), (404, rows[0][1], None), (405, rows[0][1], 0), (406, [2 * c for c in rows[0][1]], 0), (407, [], 0), (408, [1.0, 2.0], 0), (409, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as v", "1 as id", "2 as n")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.dedup(df, per_cell=per_cell).collect()}
    assert got == brute(rows)


def test_null_ids_and_large_components(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, 2.0, 1.0]
    rows = [(None, v, 0), (5, v, 0), (None, w, 0), (None, w, 1), (6, [c * 1e200 for c in v], 0), (7, [c * 1e-300 for c in v], 0), (8, [1e308] * 4, 2), (9, [-1e308] * 4, 2), (10, [float("inf")] * 4, 2), (None, None, 2), (11, [c * 4e307 for c in w], 0), (3, [1.0, 0.0, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.0, 0.0], 0), (4, [0.0, 1.0, 0.0, 0.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 99, r.n_links, r.component_id or 99, r.kept) for r in E.dedup(df).collect())
    assert got == [(3, 0, 3, True), (3, 1, 3, True), (4, 1, 3, False), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 1, 11, True), (99, 0, 99, True), (99, 0, 99, True), (99, 1, 11, False), (99, 3, 5, False)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.dedup(df).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 200)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 200)}
