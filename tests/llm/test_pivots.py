import math

import duckdb
import numpy as np
import pytest

from hitgraph.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, cell int, n_links int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, cosine=0.95):
    """[(vec_id, n_links, component_id, kept)] from all pairs."""
    rows = [r for k, r in enumerate(rows) if all(r != s for s in rows[:k])]
    fine = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    x = [np.array(v, np.float32).astype(float) if ok else None for (_, v), ok in zip(rows, fine)]
    n, low = [0] * len(rows), {i: i for i, _ in rows}
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                links.append((rows[a][0], rows[b][0]))
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted(((i, n[k], low[i], i is not None and low[i] == i) for k, (i, _) in enumerate(rows)), key=str)


def found(spark, rows, **how):
    return sorted((tuple(r) for r in pivots.near_duplicates(table(spark, rows), **how).collect()), key=str)


def test_awkward_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (5, [math.nan, 1.0, 0.0, 0.0]), (6, [math.inf, 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]),
        (7, [1.0, 0.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0, 0.0]), (9, [1e-30, 0.0, 0.0, 0.0]), (10, [1e30, 1e28, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0, 0.0]),
        (7, [1.0, 0.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0]), (12, [0.0, 3.0, 0.0, 0.0]), (13, [1.0, 0.0]), (14, [5.0, 0.0]), (15, [3.0]), (16, [-3.0]), (17, [4.0]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def crowd(seed, n=500, length=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, length))
    x[100:280] = x[0] + 0.35 * rng.normal(size=(180, length)) * rng.random((180, 1))  # a crowd with pairs on both sides of the limit
    x[280:400] = x[1] + 0.02 * rng.normal(size=(120, length))  # one tight crowd
    x[400:430] = 3 * x[2]
    return [(int(i), [float(v) for v in np.float32(r)]) for i, r in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("how", [{"crowd": 10, "block": 7}, {"crowd": 10**9, "block": 16}])
def test_crowds_against_all_pairs(spark, how):
    rows = crowd(3)
    got, want = found(spark, rows, pivots=256, **how), brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)  # an index may lose a few at the limit, and adds none
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    # with every pivot shared with every row the index is all pairs
    assert found(spark, rows, pivots=4, near=4, shared=1, **how) == want


def test_recall_at_the_limit(spark):
    rng = np.random.default_rng(8)
    x = pivots.unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z = pivots.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9501 * x + math.sqrt(1 - 0.9501**2) * z
    rows = [(2 * i + k, [float(c) for c in np.float32(v)]) for i, pair in enumerate(zip(x, y)) for k, v in enumerate(pair)]
    got = pivots.near_duplicates(table(spark, rows)).toPandas()
    assert got.n_links.max() == 1
    assert got.n_links.sum() >= 0.95 * len(rows)


def test_sql_says_the_same(spark):
    rows = crowd(4, 430)
    c = duckdb.connect()
    frame = table(spark, [*rows, rows[0], (999, None), (1000, [0.0] * 16)]).select("vec_id", "embedding").toPandas()
    c.register("frame", frame)
    c.execute("create table embeddings as select vec_id, embedding::float[] as embedding from frame")
    want = c.execute(pivots.SQL).df()
    got = pivots.near_duplicates(table(spark, [*rows, rows[0], (999, None), (1000, [0.0] * 16)]), pivots=4, near=4, shared=1).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None))
