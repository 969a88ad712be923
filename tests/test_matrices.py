import numpy as np
import pytest

from hitgraph.operators import blocks, eigen, gram, linear


def cells(spark, m, extra=()):
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame([*rows, *extra], "i long, j long, v double")


def test_eigenpairs_against_numpy(spark):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    value = np.concatenate([[9.0, -3.0, 1.0], 0.05 * rng.normal(size=37)])
    m = (q * value) @ q.T
    m = (m + m.T) / 2
    got = eigen.eigen_pairs(cells(spark, m, [(None, 1, 2.0), (1, 2, float("nan"))]), 3, eps=1e-6).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3]
    vectors = got.pivot(index="id", columns="component", values="value").to_numpy()
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-7)
    for c in range(3):
        assert abs(got[got.component == c + 1].eigenvalue.iloc[0] - value[c]) < 1e-6
        assert np.allclose(m @ vectors[:, c], value[c] * vectors[:, c], atol=1e-5)
        assert abs(abs(vectors[:, c] @ q[:, c]) - 1) < 1e-6 and (vectors[:, c] ** 3).sum() > 0


def test_eigenpairs_of_small_and_stubborn_matrices(spark):
    assert eigen.eigen_pairs(spark.createDataFrame([], "i long, j long, v double"), 3).collect() == []
    got = eigen.eigen_pairs(cells(spark, np.diag([3.0, 1.0])), 5, eps=1e-8).toPandas()
    assert got.groupby("component").eigenvalue.first().round(6).tolist() == [3.0, 1.0]
    with pytest.raises(RuntimeError, match="eigenpair 1"):  # two values of one size and unlike signs: no vector settles
        eigen.eigen_pairs(cells(spark, np.array([[0, 1.0], [1.0, 0]])) .union(cells(spark, np.array([[0.5, 0], [0, -0.5]]))), 1, most=12, eps=1e-6)


def test_blocks_equal_cells(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((37, 23)) < 0.3, rng.integers(-4, 5, (37, 23)), 0).astype(float)
    b = np.where(rng.random((23, 11)) < 0.5, rng.integers(-4, 5, (23, 11)), 0).astype(float)
    x, y = blocks.to_blocks(cells(spark, a), 8), blocks.to_blocks(cells(spark, b), 8)

    def dense(df, shape, size=8):
        out = np.zeros(shape)
        for r in blocks.from_blocks(df, size).collect():
            assert out[r.i, r.j] == 0
            out[r.i, r.j] = r.v
        return out

    assert (dense(x, a.shape) == a).all()
    assert (dense(blocks.multiply(x, y, 8), (37, 11)) == a @ b).all()
    assert (dense(blocks.transpose(x, 8), (23, 37)) == a.T).all()
    assert (dense(blocks.multiply(blocks.transpose(x, 8), x, 8), (23, 23)) == a.T @ a).all()
    assert (dense(blocks.add(x, blocks.scale(x, 2.0)), a.shape) == 3 * a).all()
    assert (dense(blocks.elementwise(x, x), a.shape) == a * a).all()
    v = spark.createDataFrame([(i, float(i + 1)) for i in range(23)], "i long, v double")
    got = {r.i: r.v for r in blocks.times_vector(x, v, 8).collect()}
    want = a @ np.arange(1.0, 24.0)
    assert got == {i: w for i, w in enumerate(want.tolist()) if w}


def test_blocks_of_awkward_cells(spark):
    odd = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (None, 1, 1.0), (1, 1, None), (1, 1, float("nan")), (-1, 0, 5.0), (300, 5, 7.0)], "i long, j long, v double")
    assert sorted(tuple(r) for r in blocks.from_blocks(blocks.to_blocks(odd)).collect()) == [(0, 0, 3.0), (300, 5, 7.0)]
    none = blocks.to_blocks(odd.where("false"))
    assert blocks.multiply(none, none).collect() == [] and blocks.add(none, none).collect() == []


def test_singular_vectors_of_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(1200, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(20, 12)))
    sigma = np.array([50.0, 30.0, 20.0, 10, 5, 3, 2, 1, 0.5, 0.3, 0.2, 0.1])
    m = (u * sigma) @ v.T
    got = linear.svd_rows(cells(spark, m), 3).toPandas()  # over MOST_SAMPLES rows: the distributed path
    assert got.id.nunique() == 1200
    rows = got.pivot(index="id", columns="component", values="value").to_numpy()
    for c in range(3):
        assert abs(got[got.component == c + 1].sigma.iloc[0] - sigma[c]) < 1e-6 * sigma[0]
        want = u[:, c] * np.sqrt(sigma[c])
        want *= np.sign(want[np.abs(want).argmax()])
        assert np.allclose(rows[:, c], want, atol=1e-6)
    monkeypatch.setattr(linear, "MOST_SAMPLES", 5)
    one = linear.svd_rows(cells(spark, m[:40]), 2).toPandas()
    monkeypatch.undo()
    two = linear.svd_rows(cells(spark, m[:40]), 2).toPandas()
    both = one.merge(two, on=["id", "component"])
    assert len(both) == 80 and np.allclose(both.value_x, both.value_y, atol=1e-6) and np.allclose(both.sigma_x, both.sigma_y, atol=1e-6)


def test_gram_pairs_where_powers_do_not_settle(spark):
    """Second and third value 0.2 % apart: 400 products of powers leave a residual above the bound."""
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    p, _ = np.linalg.qr(rng.normal(size=(45, 30)))
    value = np.concatenate([[16.0, 1.0, 0.998], np.linspace(0.997, 0.4, 27)])
    m = (p * np.sqrt(value)) @ q.T  # 45 rows of a factor, 30 ids
    factor = cells(spark, m, [(None, 1, 2.0), (1, None, 2.0), (1, 2, float("nan")), (1, 2, None)]).toDF("r", "i", "v")
    got = gram.gram_pairs(factor, 2, most=400, eps=1e-4, relative=True, stride=8, block=16, cells=500).toPandas()
    vectors = got.pivot(index="id", columns="component", values="value").to_numpy()
    assert np.allclose(vectors.T @ vectors, np.eye(2), atol=1e-7) and (vectors**3).sum(0).min() > 0
    a = m.T @ m
    for c in range(2):
        one = got[got.component == c + 1]
        theta, residual = one.eigenvalue.iloc[0], one.residual.iloc[0]
        assert abs(theta - value[c]) < 1e-4 * value[c] and residual <= 1e-4 * theta
        assert abs(np.linalg.norm(a @ vectors[:, c] - theta * vectors[:, c]) - residual) < 1e-6
    with pytest.raises(RuntimeError, match="eigenpair 1"):
        gram.gram_pairs(factor, 1, most=3, eps=1e-4, relative=True)


def test_gram_pairs_of_small_matrices(spark):
    assert gram.gram_pairs(spark.createDataFrame([], "r long, i long, v double"), 3).collect() == []
    got = gram.gram_pairs(spark.createDataFrame([("a", "x", 3.0), ("b", "y", 1.0)], "r string, i string, v double"), 5, eps=1e-6).toPandas()
    assert got.groupby("component").eigenvalue.first().round(5).tolist() == [9.0, 1.0] and set(got.id) == {"x", "y"}
    again = gram.gram_pairs(spark.createDataFrame([("a", "x", 3.0), ("b", "y", 1.0), ("c", "z", 0.5)], "r string, i string, v double"), 1, eps=1e-3, vectors=2).toPandas()  # starts again
    assert abs(again.eigenvalue.iloc[0] - 9) < 1e-3
    zero = gram.gram_pairs(spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "r int, i int, v double"), 2).toPandas()
    assert (zero.eigenvalue == 0).all() and len(zero) == 4
