import numpy as np
import pytest
from pyspark.sql import functions as F

from hitgraph.operators import evalml, evidence, layout, ranks, similarity, sparse, styling
from hitgraph.operators.written import materialize
from hitgraph.sources import files, records


def test_running_aggregates(spark):
    rows = [(g, float(o), (o * 7 + g) % 5) for g in range(3) for o in range(40)]
    df = spark.createDataFrame(rows, "g int, o double, v int")
    got = {(r.g, r.o): (r.s, r.lo) for r in ranks.running(df, ["g"], "o", {"s": ("sum", "v"), "lo": ("min", "v")}, descending=True).collect()}
    for g, o, _ in rows:
        later = [v for h, p, v in rows if h == g and p >= o]
        assert got[g, o] == (sum(later), min(later))


def test_bh_keeps_missing_p(spark):
    df = spark.createDataFrame([("a", 0.01, 1), ("a", 0.04, 2), ("a", 0.03, 3), ("a", None, 4), ("b", 0.5, 5), ("b", 0.5, 6)], "g string, p double, k int")
    got = {r.k: r.padj for r in evidence.bh_adjust(df, ["g"]).collect()}
    assert got[4] is None and [got[k] for k in (1, 2, 3, 5, 6)] == pytest.approx([0.03, 0.04, 0.04, 0.5, 0.5])


def test_metrics_by_fold(spark):
    df = spark.createDataFrame([(i, float(i % 11), i % 3 == 0, i % 2) for i in range(60)], "k int, s double, t boolean, fold int")
    got = evalml.evaluate(df, "fold", 2, lambda r: evalml.two_class_metrics(r, "s", "t", "k")).collect()
    assert [(r.fold, r.n_true, r.n_false) for r in sorted(got)] == [(0, 10, 20), (1, 10, 20)]
    with pytest.raises(Exception, match="one class"):
        evalml.two_class_metrics(df.where("t"), "s", "t", "k").collect()


def test_sparse_cells(spark):
    c = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 2, 3.0)], "i long, j long, v double")
    out = lambda d: sorted(tuple(r) for r in d.collect())
    assert out(sparse.set_cell(sparse.set_cell(c, 0, 2, 0), 1, 1, 4.0)) == [(0, 0, 1.0), (1, 1, 4.0), (1, 2, 3.0)]
    assert out(sparse.select(c, [1, 0, 1], [2], compact=True)) == [(0, 0, 3.0), (1, 0, 2.0), (2, 0, 3.0)]
    assert sparse.get(c, 1, 2).first()[0] == 3.0 and sparse.get(c, 5, 5).first()[0] == 0.0
    assert out(sparse.map_values(c, lambda v: v - 1)) == [(0, 2, 1.0), (1, 2, 2.0)]
    assert out(sparse.row_dots(c, spark.createDataFrame([(2, 10.0)], "j long, w double"))) == [(0, 20.0), (1, 30.0)]


def test_layout(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (20, 4)), rng.normal(30, 1, (20, 4))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    near = evalml.knn(df, df, "id", "v", 5)
    edges = layout.fuzzy_edges(near)
    rows = edges.collect()
    assert all(r.i < r.j and 0 < r.weight <= 1 + 1e-12 for r in rows)
    dist = {(r.query, r.neighbour): r.d2**0.5 for r in near.collect()}
    for q in (0, 25):  # one direction's weights sum to log2(k), by the same halving in numpy
        d = sorted(x for (a, _), x in dist.items() if a == q)
        far = np.array(d) - d[0]
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-far / mid).sum() > np.log2(5) else (mid, hi)
        want = {b: np.exp(-(x - d[0]) / mid) for (a, b), x in dist.items() if a == q}
        for b, w in want.items():
            got = next(r.weight for r in rows if {r.i, r.j} == {q, b})
            assert got >= w - 1e-6
    places = {r.id: (r.x, r.y) for r in layout.layout_2d(edges, df, "id", epochs=60).collect()}
    again = {r.id: (r.x, r.y) for r in layout.layout_2d(edges, df, "id", epochs=60).collect()}
    assert places == again and len(places) == 40
    at = np.array([places[i] for i in range(40)])
    close = np.linalg.norm(at[:, None] - at[None], axis=2).argsort(1)[:, 1:4]
    assert ((close < 20) == (np.arange(40)[:, None] < 20)).mean() > 0.9
    with pytest.raises(ValueError):
        layout.layout_2d(edges, df, "id", most=39)


def test_layout_in_blocks(spark, monkeypatch):
    """More vertices than one task takes are laid out too, in blocks; two crowds come apart, one vertex has no edge."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) + (0 if i < 20 else 8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    edges = materialize(layout.fuzzy_edges(evalml.knn_blocks(df, df, "id", "v", 5)))
    monkeypatch.setattr(layout, "MOST_VERTICES", 39)
    every = df.select("id").union(spark.createDataFrame([(99,)], "id long"))
    assert layout.layout_2d(edges, every, "id", epochs=1).count() == 41
    of = lambda e, epochs, **how: {r.id: (r.x, r.y) for r in layout.in_blocks(e, every, "id", epochs=epochs, block=16, **how).collect()}
    assert of(edges, 6) == of(edges.repartition(3), 6, stride=4)
    places = of(edges, 100, stride=20)
    assert places.keys() == {*range(40), 99}
    at = np.array([places[i] for i in range(40)])
    close = np.linalg.norm(at[:, None] - at[None], axis=2).argsort(1)[:, 1:4]
    assert ((close < 20) == (np.arange(40)[:, None] < 20)).mean() > 0.9


def test_records(spark, tmp_path):
    r = records.Report().section("a<b", "<p>x</p>") + records.Report((("c", "y"),))
    assert "a&lt;b" in r.render() and r.render().count("<h2") == 2
    df = spark.createDataFrame([(1, 'x,"y"'), (2, None)], "k int, t string")
    assert sorted(x.value for x in records.csv_lines(df, ["k", "t"]).collect()) == ['1,"x,""y"""', "2,"]
    assert records.html_table(df, ["k", "t"]).startswith("<table><tr><th>k</th>")
    with pytest.raises(ValueError):
        records.html_table(df, ["k"], most=1)
    cells = spark.createDataFrame([(0, 1, 2.0)], "i long, j long, v double")
    records.write_cells(cells, str(tmp_path / "m"), 3, 4)
    back, n, m = records.read_cells(spark, str(tmp_path / "m"))
    assert (n, m) == (3, 4) and back.collect() == cells.collect()
    (tmp_path / "s.json").write_text('[{"selector": "node", "style": {"w": 1}}, {"selector": "node[kind = \'a\']", "style": {"w": 2}}]')
    rules = records.read_style(spark, str(tmp_path / "s.json"))
    d = spark.createDataFrame([("a",), ("b",)], "kind string")
    assert sorted((x.kind, x.w) for x in styling.style(d, rules).collect()) == [("a", "2"), ("b", "1")]
    assert records.RunConfig.of({"screens": "a", "network": "b", "gene_sets": "c", "output": "d", "threads": "4"}).threads == 4
    with pytest.raises(ValueError):
        records.RunConfig.of({"nonsense": "1"})
    assert sorted([records.WalkParameters(0.5, 15, 10), records.WalkParameters(0.2, 15, 10)])[0].name == "restart=0.2,steps=15,rank=10,normalise=false"
    records.write_sheets({"one": df}, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book/one")).count() == 2
    (tmp_path / "lfc.tsv").write_text("sgrna\tGene\tLFC\ng1\tA\t1.5\ng1\tA\t1.5\ng2\tB\tbad\n")
    assert sorted((x.gene, x.lfc) for x in records.read_guide_changes(spark, str(tmp_path / "lfc.tsv"), "c1").collect()) == [("A", 1.5), ("B", None)]
    lines = spark.createDataFrame([("s\td\ta\tb",), ("t",)], "value string")
    assert sorted(tuple(x) for x in files.gmt(lines).collect()) == [("s", "a"), ("s", "b")]


def test_leading_edge_and_recurrence(spark):
    hits = spark.createDataFrame([("x", 1, 5.0, 10), ("x", 2, 4.0, 10), ("x", 9, 1.0, 10), ("y", 8, 1.0, 10), ("y", 10, 1.0, 10)], "set string, pos long, stat double, n long")
    assert sorted((r.set, r.pos) for r in similarity.leading_edge(hits, ["set"]).collect()) == [("x", 1), ("x", 2), ("y", 8), ("y", 10)]


def test_numbered_and_medians(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 2, 1), ("a", 1, 9), ("b", 5, 5), ("b", 7, 7), ("b", 7, 8)], "g string, v int, k int")
    got = sorted((r.g, r.i, r.v, r.k) for r in ranks.numbered(df, ["g"], ["v", "k"]).collect())
    assert got == [("a", 1, 1, 9), ("a", 2, 2, 1), ("a", 3, 2, 1), ("b", 1, 5, 5), ("b", 2, 7, 7), ("b", 3, 7, 8)]
    some = spark.createDataFrame([("even", x) for x in (1, 2, 4, 100)] + [("odd", x) for x in (3, 3, 9)] + [("hot", 5)] * 1000 + [("hot", 6)] * 1000, "g string, v int")
    assert {r.g: r["median"] for r in ranks.medians(ranks.ranked(some, ["g"], "v"), ["g"], "v").collect()} == {"even": 3.0, "odd": 3.0, "hot": 5.5}


def test_guide_qc(spark):
    v = {"x": [0, 0, 3, 8, 8, 1000], "y": [1, 2, 2]}
    df = spark.createDataFrame([(g, x) for g, xs in v.items() for x in xs], "g string, v long")
    for r in evidence.guide_qc(df, "g", "v").collect():
        x = np.array(v[r.g])
        lv = np.sort(np.log2(x + 1))
        gini = ((2 * np.arange(1, len(x) + 1) - len(x) - 1) * lv).sum() / (len(x) * lv.sum())
        want = (x.sum(), 100 * (x == 0).mean(), np.median(x), 1.4826 * np.median(np.abs(x - np.median(x))), x.max(), gini)
        assert (r.total, r.pct_zero, r.med, r.mad, r.top, r.gini) == pytest.approx(want)
