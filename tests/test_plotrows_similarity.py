import numpy as np
import pytest
from pyspark.sql import functions as F

from hitgraph.operators import evalml, graph, plotdata, plotrows, similarity
from hitgraph.plans import catalog, matrices


def test_colours(spark):
    v = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    c = F.col("v")
    got = v.select(plotrows.heat(c).alias("h"), plotrows.log_heat(c).alias("l"), plotrows.gray(c, clear_below=True).alias("g"), plotrows.red_blue(c).alias("rb"), plotrows.manual(c, {1.0: (1, 2, 3)}, (9, 9, 9)).alias("m")).collect()
    assert [tuple(r.h) for r in got] == [(0, 0, 255, 255), (0, 255, 0, 255), (255, 0, 0, 255), (255, 0, 0, 255), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert tuple(got[0].l) == (0, 0, 255, 255) and tuple(got[2].l) == (255, 0, 0, 255)
    assert tuple(got[0].g) == (255, 255, 255, 255) and tuple(got[2].rb) == (255, 0, 0, 255) and tuple(got[0].rb) == (0, 0, 255, 255)
    assert tuple(got[2].m) == (1, 2, 3, 255) and tuple(got[1].m) == (9, 9, 9, 255)


def test_box_by_place(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 2, 9)] + [("b", 5.0), ("c", None), ("d", float("nan"))]
    got = {r.g: tuple(r)[1:] for r in plotdata.box(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"a": (1.0, 1.5, 2.0, 5.5, 9.0), "b": (5.0,) * 5}


def test_places_ties_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 1), (None, 2), (2.0, 3), (7.0, 4)], "v double, id int")
    got = {r.id: r.ordinal for r in plotrows.places(df, [], ["v", "id"], True).collect()}
    assert got == {4: 0, 1: 1, 3: 2, 2: 3}


def test_cells_and_scaler(spark):
    twice = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0)], "i int, j int, v double")
    with pytest.raises(Exception, match="given twice"):
        similarity.unique_cells(twice).collect()
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (None, None)], "x double, y double")
    got = similarity.Standardiser(["x", "y"]).fit(df).transform(df).collect()
    assert np.allclose([r.x for r in got[:2]], [-(0.5**0.5), 0.5**0.5]) and [r.y for r in got] == [0.0, 0.0, None] and got[2].x is None


def test_power_iteration(spark):
    m = np.array([[2.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 2.0]])
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]], "i int, j int, v double")
    got = {r.id: r for r in similarity.power_iteration(cells, eps=1e-10).collect()}
    assert np.allclose([got[i].v for i in range(3)], np.array([1, 2, 1]) / 6**0.5, atol=1e-3) and np.isclose(got[0].eigenvalue, 4.0, atol=1e-3)


def test_mashup(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 1.0)]
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id int")
    e = spark.createDataFrame(edges, "src int, dst int, w double")
    got = {(r.id, r.component): r.value for r in graph.mashup([e], nodes, 3).collect()}
    a = np.zeros((5, 5))
    for s, t, w in edges:
        a[s, t] = a[t, s] = w
    a[4, 4] = 1.0
    a /= a.sum(0)
    p = np.eye(5)
    for _ in range(15):
        p = 0.5 * np.eye(5) + 0.5 * a @ p
    u, s, _ = np.linalg.svd(np.log(p + 0.2))
    for k in range(3):
        assert np.allclose(np.abs([got[i, k + 1] for i in range(5)]), np.abs(u[:, k]) * s[k] ** 0.5, atol=1e-6)


def test_kmeans(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(20)]
    at, costs = evalml.kmeans(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", [(0, [0.0, 0.0]), (1, [1.0, 0.0])])
    assert {(r.id % 2, r.centre) for r in at.collect()} == {(0, 0), (1, 1)} and costs == sorted(costs, reverse=True)


def test_gsea_against_loops(spark):
    r = np.random.default_rng(5)
    stat = np.sort(r.exponential(size=40))[::-1]
    ranked = spark.createDataFrame([("c", f"g{i}", float(stat[i]), i + 1, 40) for i in range(40)], "comparison string, gene string, stat double, pos long, n long")
    members = {"top": range(6), "low": range(30, 40), "mixed": [1, 7, 22, 35], "small": [1, 2]}
    sets = spark.createDataFrame([(s, f"g{i}") for s, m in members.items() for i in m] + [("top", "unknown"), ("top", "g0")], "set string, member string")
    got = {x.set: x for x in similarity.gsea(ranked, sets, permutations=50).collect()}
    assert set(got) == {"top", "low", "mixed"}
    for name, x in got.items():
        inside = set(members[name])
        at, path = 0.0, []
        for i in range(40):
            at += stat[i] / sum(stat[j] for j in inside) if i in inside else -1 / (40 - len(inside))
            path.append(at)
        best = max(path) if max(path) >= -min(path) else min(path)
        assert np.isclose(x.es, best) and 0 < x.p <= 1 and x.p <= x.padj + 1e-12
    assert got["top"].p < 0.1 < got["mixed"].p


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_gsea_sets_stay_in_bounds_as_tables_grow(spark, scale):
    d = f"/root/testdata/{scale}"
    sets = matrices._gene_sets(spark, d)
    got = similarity.gsea(matrices._ranked_z(spark, d).where("comparison = 1"), sets, permutations=5).collect()
    assert {r.set for r in got} == {r.set for r in sets.select("set").distinct().collect()} and len(got) >= 25


def _vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return {r.vec_id: np.array(r.embedding, float) for r in rows}


def test_queries_meet_all_other_rows(spark, sf):
    v = _vectors(spark, sf)
    want = {(a, b) for a in v if a % 50 == 0 for b in v if a != b}
    d2 = catalog.QUERIES["sq_euclid"](spark, sf).collect()
    cos = catalog.QUERIES["cosine"](spark, sf).collect()
    assert len(d2) == len(cos) == len(want) and {(r.a, r.b) for r in d2} == {(r.a, r.b) for r in cos} == want
    assert all(np.isclose(r.d2, ((v[r.a] - v[r.b]) ** 2).sum(), atol=2e-6) for r in d2)
    assert all(np.isclose(r.cosine, v[r.a] @ v[r.b] / (np.linalg.norm(v[r.a]) * np.linalg.norm(v[r.b])), atol=2e-6) for r in cos)


def test_neighbours_of_all_stated_queries(spark, sf):
    v = _vectors(spark, sf)
    near = {q: sorted((b for b in v if b != q), key=lambda b: (((v[q] - v[b]) ** 2).sum(), b)) for q in v if q % 50 == 0}
    got = {(r.query, r["rank"]): r.neighbour for r in catalog.QUERIES["knn_graph"](spark, sf).collect()}
    assert got == {(q, i + 1): b for q, o in near.items() for i, b in enumerate(o[:15])}
    ends = {(r.u, r["rank"]): r.v for r in catalog.QUERIES["segment_endpoints"](spark, sf).collect()}
    assert ends == {(q, i + 1): b for q, o in near.items() for i, b in enumerate(o[:5])}
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    blocks = evalml.knn_blocks(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 15, most=8)
    assert {(r.query, r["rank"]): r.neighbour for r in blocks.collect()} == got


def test_forest_query_takes_the_default_trees(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(evalml, "forest_cv", lambda *a, **b: seen.update(b))
    catalog.QUERIES["rf_cv"](spark, sf)
    assert seen.get("trees", 500) == 500
