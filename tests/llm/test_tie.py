import time

import numpy as np
from skymosaic.llm.components import tie


def test_labels_are_those_of_a_plain_search():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (5, 3), (200, 120), (500, 2_000), (3_000, 2_900)):
        s, t = rng.integers(0, n, m), rng.integers(0, n, m)
        label = np.arange(n)
        for part in np.array_split(np.arange(m), 3):
            label = tie(label, s[part], t[part])
        near = [[] for _ in range(n)]
        for a, b in zip(s.tolist(), t.tolist()):
            near[a].append(b)
            near[b].append(a)
        want = [None] * n
        for k in range(n):
            todo = [k] if want[k] is None else []
            while todo:
                x = todo.pop()
                if want[x] is None:
                    want[x] = k
                    todo += near[x]
        assert label.tolist() == want


def test_chains_and_groups_of_very_many_pairs():
    n = 20_000
    order = np.random.default_rng(2).permutation(n)
    assert (tie(np.arange(n), order[:-1], order[1:]) == 0).all()
    begin = time.process_time()
    s, t = np.triu_indices(3_000, 1)
    assert (tie(np.arange(3_000), s, t) == 0).all()
    assert time.process_time() - begin < 3  # 4.5 million pairs
