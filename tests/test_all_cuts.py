"""Row cuts are searched among all offsets of a source, however many it has."""

from skymosaic.operators import splits

N = 150


def test_every_offset_is_a_cut(spark):
    # one source of 150 rows of tiles; a class lies in three rows only, so that just one pair of cuts gives each split its part
    tiles = spark.createDataFrame([(1, i, i * 10, 10) for i in range(N)], "source_id long, tile_id long, y_off long, th long")
    rows = [(i, 0) for i in range(N)] + [(i, 1) for i in (104, *[105] * 3, *[127] * 3)] + [(0, 1)] * 13
    labels = spark.createDataFrame(rows, "tile_id long, class_id int")
    scored = splits.boundary_search(tiles, labels)
    assert scored.count() == N * (N - 1) // 2

    def penalty(n):
        whole = sum(n)
        return sum((v / whole - t) ** 2 * whole for v, t in zip(n, (0.7, 0.15, 0.15))) + 1e6 * ((n[1] == 0) + (n[2] == 0)) if whole else 0.0

    def plain(a, b):
        of = lambda c: [sum(k == c and lo <= i < hi for i, k in rows) for lo, hi in ((0, a), (a, b), (b, N))]
        return sum(penalty(of(c)) for c in (0, 1))

    near = [(a, b) for a in range(N) for b in range(a + 1, N) if all(abs(v / N - t) <= 0.1 for v, t in zip((a, b - a, N - b), (0.7, 0.15, 0.15)))]
    best = min((round(plain(a, b), 6), a * 10, b * 10) for a, b in near)
    found = splits.best_boundaries(scored, tiles).first()
    assert (found.score, found.b1, found.b2) == best
    assert found.b1 % 20 or found.b2 % 20  # with every second offset only it would not be found
