import numpy as np

from hitgraph.operators import axes, linear


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")


def test_pca_and_loadings(spark):
    m = np.random.default_rng(1).normal(size=(4, 30)) * [[1], [2], [3], [4]]
    c = cells(spark, m)
    scores = linear.pca(c)
    got = {(r.i, r.component): r.score for r in scores.collect()}
    x = m - m.mean(0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    for k in range(3):
        have = np.array([got[i, k + 1] for i in range(4)])
        assert np.allclose(np.abs(have), np.abs(u[:, k] * s[k]))
    load = {(r.j, r.component): r.loading for r in linear.loadings(c, scores).collect()}
    assert np.allclose([abs(load[j, 1]) for j in range(30)], np.abs(v[0]))
    assert linear.pca(c.limit(0)).count() == 0


def test_svd_rows(spark, monkeypatch):
    monkeypatch.setattr(linear, "MOST_SAMPLES", 10)  # more rows than that take the iteration
    r = np.random.default_rng(2)
    m = r.normal(size=(30, 6)) @ r.normal(size=(6, 20))
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    got = {(x.id, x.component): x.value for x in linear.svd_rows(cells(spark, m), 2, extra=4, rounds=4).collect()}
    for k in range(2):
        assert np.allclose(np.abs([got[i, k + 1] for i in range(30)]), np.abs(u[:, k]) * np.sqrt(s[k]), atol=1e-5)


def test_ticks_window_scale(spark):
    major, minor = axes.ticks(0.3, 9.7, 5)
    assert major == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0] and len(minor) == 15
    df = spark.createDataFrame([(1.0, 5.0), (None, float("nan")), (3.0, 200.0)], "x double, y double")
    assert tuple(axes.window(df, ["x"], 0.5).first()) == (0.0, 4.0)
    assert np.allclose(tuple(axes.window(df, ["y"], log10=True).first()), (1.0, 1000.0))
    assert tuple(axes.window(df.limit(0), ["x"], 0.0).first()) == (0.0, 1.0)


def test_volcano(spark):
    rows = [("a", 2.0, 0.0, 0.01), ("b", 1.0, 0.01, 0.02), ("NO_SITE_1", 0.5, 0.5, 0.5), ("c", -1.0, 0.1, 0.01), ("d", 1.0, 0.2, 0.9)]
    got = {r.label: r for r in axes.volcano(spark.createDataFrame(rows, "label string, e double, p double, f double"), "label", "e", "p", "f", top=1).collect()}
    assert {k: r.hit for k, r in got.items()} == {"a": "up", "b": "up", "NO_SITE_1": "ctrl", "c": "down", "d": "a"}
    assert [k for k in sorted(got) if got[k].text] == ["a", "c"] and got["a"].y == got["b"].y


def test_density_and_contour(spark):
    pts = np.random.default_rng(3).normal(size=(200, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double")
    d = axes.density2d(df, "x", "y", 0.2, 12)
    one = d.where("ix = 5 and iy = 7").first()
    want = np.exp(-0.5 * ((pts - [one.gx, one.gy]) ** 2).sum(1) / 0.2).sum() / (200 * 0.04)
    assert np.isclose(one.density, want)
    flat = spark.createDataFrame([(i, j, float(i), float(j), float(i)) for i in range(3) for j in range(3)], "ix long, iy long, gx double, gy double, density double")
    seg = axes.contour(flat, [0.5]).collect()
    assert len(seg) == 4 and all(abs(s.x0 - 0.5) < 1e-12 and abs(s.x1 - 0.5) < 1e-12 for s in seg)
