import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coverscope.llm import centroids


def plain(rows, k, rounds, dim, scale=256):
    """All vectors against all centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((gap(v, c), j) for j, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(now)):
            own = [v for (_, v), (_, c) in zip(kept, got, strict=True) if c == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = assign()
    inertia = {j: sum(d for d, c in got if c == j) for j in range(len(now))}
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, got, strict=True)]


def invariants(x, tree):
    for n in range(len(tree.point)):
        own = tree.order[tree.low[n] : tree.high[n]]
        gaps = np.sqrt(((x[own] - x[tree.point[n]]) ** 2).sum(1))
        assert tree.point[n] in own and gaps.max() <= tree.radius[n] + 1e-9
        kids = range(tree.first[n], tree.last[n])
        if kids:
            assert tree.low[kids[0]] == tree.low[n] and tree.high[kids[-1]] == tree.high[n] and tree.point[kids[0]] == tree.point[n]
            assert all(tree.high[a] == tree.low[a + 1] for a in kids[:-1])
            points = x[tree.point[tree.first[n] : tree.last[n]]]
            apart = np.sqrt(((points[:, None] - points) ** 2).sum(2)) + np.diag([np.inf] * len(points))
            assert apart.min() > tree.radius[tree.first[n] : tree.last[n]].max() - 1e-9


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 30), st.integers(1, 5), st.sampled_from([1, 3, 50, 4000, 2**24]))
def test_trees_find_what_comparing_all_finds(seed, n, k, dim, high):
    r = np.random.default_rng(seed)
    x, c = r.integers(-high, high + 1, (n, dim)), r.integers(-high, high + 1, (k, dim))
    kind = np.int64 if high > 2**22 else np.float64
    x, c = x.astype(kind), c.astype(kind)
    tree = centroids.cover_tree(x)
    invariants(x.astype(float), tree)
    got, _ = centroids.nearest(x, tree, c, centroids.cover_tree(c, leaf=1))
    assert got.tolist() == ((x[:, None] - c) ** 2).sum(2).argmin(1).tolist()


def test_bounds_prune():
    r = np.random.default_rng(5)
    middles = r.integers(-9000, 9000, (60, 8))
    x = (middles[r.integers(0, 60, 3000)] + r.integers(-40, 41, (3000, 8))).astype(float)
    got, taken = centroids.nearest(x, centroids.cover_tree(x), middles.astype(float), centroids.cover_tree(middles.astype(float), leaf=1))
    assert got.tolist() == ((x[:, None] - middles) ** 2).sum(2).argmin(1).tolist()
    assert taken < 0.2 * 3000 * 60


def odd_rows(dim):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=dim).tolist()) for i in range(90)] + [(200 + i, [0.5] * dim) for i in range(40)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, None), (301, [0.1] * (dim - 1)), (302, [0.1] * (dim - 1) + [None]), (303, [float("nan")] * dim), (304, [float("inf")] * dim), (305, []), (306, [-3000.25] * dim), (307, [-0.0] * dim)]
    return rows


@pytest.mark.parametrize("k,rounds,block", [(12, 5, 16), (12, 0, 2048), (1, 2, 50), (500, 3, 64)])
def test_rows(spark, monkeypatch, k, rounds, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = odd_rows(6)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = centroids.clustered(df, k, rounds, 6)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, k, rounds, 6)))
    assert centroids.clustered(df.where("false"), k, rounds, 6).count() == 0
    assert centroids.clustered(df.where("vec_id >= 300 and vec_id < 306"), k, rounds, 6).collect() == []


def test_large_components(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).integers(-400_000, 400_000, (60, 6)).tolist())]
    df = spark.createDataFrame([*rows, (99, [1e30] * 6)], "vec_id long, embedding array<double>")
    assert sorted(map(str, map(tuple, centroids.clustered(df, 7, 3, 6).collect()))) == sorted(map(str, plain(rows, 7, 3, 6)))
    table = centroids.centroid_table(df, 7, 3, 6).collect()
    assert len(table) == 7 and all(len(r["centroid"]) == 6 for r in table)
