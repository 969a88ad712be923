import math

import numpy as np

from hitgraph.operators import clusters


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, _k string, centre int")


def lloyd(x, centres, steps):
    costs = []
    for _ in range(steps):
        at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        old, centres = centres, np.array([x[at == k].mean(0) if (at == k).any() else c for k, c in enumerate(centres)])
        costs.append(((x - centres[at]) ** 2).sum())
    return at, centres, costs


def test_steps_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 3)) for c in (np.zeros(3), np.full(3, 5.0), np.array([9.0, 0, 0]))]) + 1e6  # far from 0: digits must hold
    points = frame(spark, [(i, v.tolist(), "x", 1) for i, v in enumerate(x)])
    got = clusters.kmeans_full(points, "id", "v", 3, restarts=4, iterations=6, seed=2)
    held = points.selectExpr("id as _k", "v as _v")
    runs = [lloyd(x, s, 7) for s in clusters.seeds(held, 3, 4, 2)]
    cost = {(r.restart, r.step): r.cost for r in got.costs.collect()}
    assert len(cost) == 28
    assert all(math.isclose(cost[r, s], c, rel_tol=1e-6) for r, run in enumerate(runs) for s, c in enumerate(run[2]))
    at, centres, _ = min(runs, key=lambda run: run[2][-1])
    rows = sorted(got.assignment.collect())
    assert [r.centre for r in rows] == at.tolist()
    assert np.allclose([r.distance for r in rows], np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1).min(1)), rtol=1e-6)
    assert np.allclose([r.vector for r in sorted(got.centres.collect())], centres, rtol=1e-9)
    assert len({r.centre for r in rows}) == 3 and all(len({r.centre for r in rows[a : a + 60]}) == 1 for a in (0, 60, 120))  # the crowds are found


def test_seeds_repeat_and_follow_the_distance(spark):
    rng = np.random.default_rng(1)
    x = [(i, [float(i >= 95) * 1000.0 + float(rng.random())]) for i in range(100)]
    one = spark.createDataFrame(x, "_k long, _v array<double>")
    two = spark.createDataFrame(x[::-1], "_k long, _v array<double>").repartition(5)
    a, b = clusters.seeds(one, 2, 30, 9), clusters.seeds(two, 2, 30, 9)
    assert all((p == q).all() for p, q in zip(a, b))
    assert sum(abs(p[0, 0] - p[1, 0]) > 500 for p in a) == 30  # the second seed lies in the other crowd
    assert 0 < sum(p[0, 0] > 500 for p in a) < 12  # the first by count alone
    assert not all((p == q).all() for p, q in zip(a, clusters.seeds(one, 2, 30, 10)))


def test_awkward_points(spark):
    rows = [(1, [0.0, 0.0], "a", 1), (2, [0.0, 0.0], "a", 1), (3, [1.0, 1.0], "a", 1), (4, None, "a", 1), (5, [1.0, None], "a", 1), (6, [math.nan, 1.0], "a", 1), (None, [1.0, 1.0], "a", 1), (7, [2.0], "a", 1), (8, [], "a", 1)]
    got = clusters.kmeans_full(frame(spark, rows), "id", "v", 5, iterations=2)
    assert sorted((r.key, r.distance) for r in got.assignment.collect()) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert got.centres.count() == 2  # two distinct points give two seeds
    assert clusters.kmeans_full(frame(spark, []), "id", "v", 3).assignment.collect() == []
