import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hitgraph.llm import negatives


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, rank int, anchor int")


def brute(rows, every=50, positives=5, negs=3, low=50, high=95):
    """Sorted rows of the result, from all pairs and Python's whole numbers."""
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (i, v, label) not in kept:
            kept.append((i, v, label))
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept]
    out = []
    for i, q, label in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, v, other in rows if j != i and len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            good = [(j, -s) for s, j, other in scored if other != label and low * -ps <= 100 * -s <= high * -ps]
            out += [(i, p, k + 1, j, -ps, s) for k, (j, s) in enumerate(good[:negs])]
    return sorted(out)


def found(spark, rows, every=50, **how):
    return sorted(tuple(r) for r in negatives.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **how).collect())


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [1.0, None], 1), (4, [math.nan, 1.0], 2), (5, [math.inf, 1.0], 2), (6, [0.7, 0.5], None), (None, [0.7, 0.5], 2),
        (7, [0.7, 0.5], 2), (8, [0.7, 0.5], 2), (9, [0.7, 0.5], 3), (10, [0.9, 0.6], 2), (11, [], 1), (50, [], 2), (51, [], 2), (52, [], 1), (100, [1.0, 0.2, 0.1], 4), (101, [1.0, 0.1, 0.1], 4), (102, [0.6, 0.1, 0.1], 5), (150, [0.0, 0.0], 9), (151, [0.0, 0.0], 9), (200, [-1.0, 0.3], 7), (201, [1.0, 0.3], 7),
    ]
    assert brute(rows)
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("kind", ["random", "crowd", "few labels", "many labels"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "LEAF", 16)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(700, 12)) * 0.3
    if kind == "crowd":  # many ties
        x[200:500] = np.round(x[0] + 0.01 * rng.normal(size=(300, 12)), 2)
    label = rng.integers(0, {"few labels": 2, "many labels": 200}.get(kind, 10), 700)
    rows = [(int(i), [float(c) for c in v], int(k)) for i, v, k in zip(rng.permutation(700), x, label)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_several_blocks_and_other_numbers(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=6)], int(rng.integers(0, 4))) for i in range(400)]
    assert found(spark, rows, 5, positives=2, negatives=7, low=30, high=80) == brute(rows, 5, 2, 7, 30, 80)


def test_great_numbers():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) * 1e6
    column = pa.array(x.tolist())
    one, two = negatives.numbers(column, column, scale=256.0)
    assert one.dtype == np.int64 and one.tolist() == [[math.floor(256 * c) for c in v] for v in x.tolist()]
    with pytest.raises(ValueError, match="64 bits"):
        negatives.numbers(pa.array([[1e9, 1e9]]), pa.array([[1e9, 1e9]]), scale=256.0)


def test_trees_prune_and_keep_all():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.floor(1000 * c + 10 * rng.normal(size=(300, 8))) for c in np.eye(8)])  # eight tight crowds
    labels = np.repeat(np.arange(8), 300)
    ids = rng.permutation(len(x))
    tree = negatives.Tree(x, ids, labels)
    assert sorted(tree.ids.tolist()) == sorted(ids.tolist())
    for node, (a, b) in enumerate(tree.span):
        assert np.sqrt(((tree.x[a:b] - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
    seen = []
    best = negatives.Best(np.full((1, 1), 900_000), np.full((1, 1), 2_000_000), 3)
    add = best.add
    best.add = lambda q, score, i, ok: (seen.append(len(i)), add(q, score, i, ok))
    negatives.search([(None, tree)], x[:1], np.array([99]), np.array([-1]), best, False)
    want = sorted(zip((-(x @ x[0])).tolist(), ids.tolist()))[:3]
    assert [(-s, i) for s, i in zip(best.score[0, 0].tolist(), best.id[0, 0].tolist())] == want
    assert sum(seen) < 700  # of 2400 rows


def test_sql_says_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=8))], int(rng.integers(0, 10))) for i in range(600)]
    rows += [rows[3], (1000, None, 1), (1001, [0.5] * 8, None)]
    c = duckdb.connect()
    c.register("frame", table(spark, rows).select("vec_id", "embedding", "label").toPandas())
    c.execute("create table embeddings as select vec_id, embedding::float[] as embedding, label::int as label from frame")
    want = c.execute(negatives.SQL).df()
    label = F.col("label").cast("long")
    mine = table(spark, rows, "double").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    got = negatives.hard_negatives(mine, F.col("vec_id") % 50 == 0).toPandas()
    assert len(want) and sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None))
