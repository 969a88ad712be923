"""Findings of round 4."""

import numpy as np

from hitgraph.operators import similarity, steps
from hitgraph.plans import catalog


def _score(stat, at, n):
    hit, k = np.cumsum(stat[at]) / stat[at].sum(), np.arange(len(at))
    miss = (at - k) / (n - len(at))
    top, low = (hit - miss).max(), (hit - stat[at] / stat[at].sum() - miss).min()
    return top if top >= -low else low


def test_null_scores_are_no_rows_and_equal_a_loop_over_the_same_draws(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_BLOCK", 64, raising=False)  # several blocks of stats
    rng, n = np.random.default_rng(3), 300
    stats = {c: np.sort(rng.exponential(size=n))[::-1] for c in ("a", "b")}
    ranked = spark.createDataFrame([(c, g, float(x), g + 1, n) for c, v in stats.items() for g, x in enumerate(v)], "comparison string, gene int, stat double, pos long, n long")
    members = {"top": range(12), "some": range(5, 300, 25), "low": range(250, 290), "other": sorted(rng.choice(n, 40, replace=False).tolist())}
    sets = spark.createDataFrame([(s, int(g)) for s, m in members.items() for g in m], "set string, member int")
    df = similarity.gsea(ranked, sets, permutations=60)
    assert "MapInPandas" not in df._jdf.queryExecution().toString()  # a row a drawn place
    got = {(r.comparison, r.set): r for r in df.collect()}
    assert set(got) == {(c, s) for c in stats for s in members}
    for (c, s), r in got.items():
        at = np.array(sorted(members[s]))
        es = _score(stats[c], at, n)
        draws = [np.sort(np.random.default_rng([7, len(at), k, *c.encode()]).choice(n, len(at), replace=False, shuffle=False)) for k in range(60)]
        null = np.array([_score(stats[c], d, n) for d in draws])
        same = null[(null >= 0) == (es >= 0)]
        assert np.isclose(r.es, es) and np.isclose(r.p, ((np.abs(same) >= abs(es)).sum() + 1) / (len(same) + 1)), r
        assert np.isclose(r.nes, es / np.abs(same).mean()) if len(same) else r.nes is None


def _vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = {i: rng.integers(-9, 10, 3).astype(float) for i in range(1, 61)}
    rows = [(i, [float(y) for y in x], 0) for i, x in v.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return v, str(tmp_path)


def test_cosine_of_all_pairs(spark, tmp_path):
    v, d = _vectors(spark, tmp_path)
    got = {(r.a, r.b): r.cosine for r in catalog.QUERIES["cosine"](spark, d).collect()}
    assert set(got) == {(a, b) for a in v for b in v if a != b}
    for (a, b), c in got.items():
        assert c is None if not (v[a].any() and v[b].any()) else np.isclose(c, v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]), atol=2e-6)


def _near(v, k):
    return {q: sorted((b for b in v if b != q), key=lambda b: (((v[q] - v[b]) ** 2).sum(), b))[:k] for q in v}


def test_neighbours_of_every_row(spark, tmp_path):
    v, d = _vectors(spark, tmp_path)
    got = {(r.query, r["rank"]): r.neighbour for r in catalog.QUERIES["knn_graph"](spark, d).collect()}
    assert got == {(q, i + 1): b for q, o in _near(v, 15).items() for i, b in enumerate(o)}


def test_segments_of_every_row(spark, tmp_path):
    v, d = _vectors(spark, tmp_path)
    got = {(r.u, r["rank"]): (r.v, r.x1, r.y1, r.x2, r.y2) for r in catalog.QUERIES["segment_endpoints"](spark, d).collect()}
    assert got == {(q, i + 1): (b, *v[q][:2], *v[b][:2]) for q, o in _near(v, 5).items() for i, b in enumerate(o)}


def test_tiles_of_a_hub_are_bounded(spark):
    """All cells lie between few blocks: they give more tiles, not larger ones."""
    rows = [(0, i, 1.0) for i in range(1, 2001)]
    m = spark.createDataFrame(rows, "src long, dst long, w double")
    names = spark.createDataFrame([(i, 0, i) for i in range(2001)], "id long, b int, at int")
    tiles, parts = steps.packed(m, names, 100)
    got = tiles.collect()
    assert sum(len(r.src) // 4 for r in got) == 2000 and max(len(r.src) // 4 for r in got) < 200
    assert parts == 3 and len({r.part for r in got}) == 3
    p = steps.repeated(m, spark.createDataFrame([(0, 1.0)], "id long, p double"), 1, cells=100)
    assert {(r.id, r.p) for r in p.collect()} == {(i, 1.0) for i in range(1, 2001)}
