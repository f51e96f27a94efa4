"""Thinner edges keep components."""

import random

from skymosaic.llm.components import thinned


def components(edges):
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(label)}


def test_members_of_many_groups_keep_one_edge(spark):
    rng = random.Random(3)
    group = [(100 + n, least) for n in range(500) for least in rng.sample(range(24), 12)]
    other = [(1000 + k, 1000 + rng.randrange(k + 1)) for k in range(300) for _ in range(2)]
    edges = sorted({(a, b) for a, b in group + other if a != b})
    got = [tuple(r) for r in thinned(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert components(got) == components(edges)
    assert len(got) == len(set(got)) and sum(a < 1000 for a, _ in got) <= 500 + 24 * 24
