import numpy as np
from pyspark.sql import functions as F

from hitgraph.operators import evalml, graph, tables
from hitgraph.sources import records


def test_mashup_of_two_graphs_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, frames, states = 12, [], []
    for _ in range(2):
        a = np.triu(rng.random((n, n)) < 0.35, 1) * rng.integers(1, 6, (n, n))
        a = a + a.T
        frames.append(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(i, n) if a[i, j]], "src long, dst long, w double"))
        m = np.where(a.sum(0) > 0, a / np.maximum(a.sum(0), 1), np.eye(n))
        p = np.eye(n)
        for _ in range(15):
            p = 0.5 * np.eye(n) + 0.5 * m @ p
        states.append(np.log(p + 1 / n))
    u, s, _ = np.linalg.svd(np.concatenate(states, axis=1))
    got = graph.mashup(frames, spark.range(n), k=4).toPandas()
    rows = got.pivot(index="id", columns="component", values="value").to_numpy()
    for c in range(4):
        want = u[:, c] * np.sqrt(s[c])
        want *= np.sign(want[np.abs(want).argmax()])
        assert np.allclose(rows[:, c], want, atol=1e-7)


def test_gene_graph_by_hand(spark):
    nodes = spark.createDataFrame([(1, "A", "gene"), (2, "B", "gene"), (3, "C", "gene"), (4, "d1", "drug"), (5, "x", "odd"), (6, "y", "odd")], "id long, name string, type string")
    edges = spark.createDataFrame([(1, 2, "binds", "old", 1), (2, 1, "binds", "new", 2), (1, 2, "acts", "a", 3), (1, 3, "binds", "no: C is not chosen", 4), (4, 1, "targets", "t", 5), (4, 3, "targets", "no", 6), (1, 5, "odd", "kept by name", 7), (1, 6, "odd", "no: of no type asked for", 8), (4, 5, "odd", "no gene", 9)], "source long, target long, relation string, attribute string, ordinal long")
    genes = spark.createDataFrame([("A",), ("B",), ("A",), ("unknown",)], "name string")
    left, multi = records.gene_graph(nodes, edges, genes, "gene", ["gene", "drug"], ["x"], [("type", "drug", {"color": "red"})])
    assert sorted((r.u, r.v, r.relation, r.attribute) for r in multi.collect()) == [(1, 2, "acts", "a"), (1, 2, "binds", "new"), (1, 4, "targets", "t"), (1, 5, "odd", "kept by name")]
    assert {(r.name, r.color) for r in left.collect()} == {("A", None), ("B", None), ("d1", "red"), ("x", None)}


def test_download_takes_all_pages(spark):
    df = spark.createDataFrame([(i, f'n"{i}' if i == 5 else f"n{i}", "x") for i in range(250)], "id long, name string, other string")
    q = tables.TableQuery(["id"], "", projection=["name"], sort="id", descending=True, page_size=100)
    lines = [r.value for r in q.download(df).collect()]
    assert lines[0] == "id,name" and lines[1] == "249,n249" and len(lines) == 251
    assert lines[-6] == '5,"n""5"'
    assert q.run(df).count() == 100


def test_forest_separates_and_repeats(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 120)
    df = spark.createDataFrame([(i, [float(k + 0.2 * rng.normal()), float(rng.normal())], int(k)) for i, k in enumerate(y)], "id long, v array<double>, t int")
    one = {r.id: r.p for r in evalml.forest_cv(df, "id", "v", "t", trees=25).collect()}
    assert np.mean([(one[i] > 0.5) == bool(y[i]) for i in range(120)]) > 0.95
    assert {r.id: r.p for r in evalml.forest_cv(df, "id", "v", "t", trees=25).collect()} == one


def test_pairs_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i)], 1) for i in range(20)], "id long, v array<double>, query int")
    some = df.where("id % 2 = 0")
    one = {(r["query"], r.id) for r in evalml.against_all(some, df.drop("query"), "id", "v").collect()}
    two = [(r["query"], r.id) for r in evalml.against_all(some, df.drop("query"), "id", "v", most=3).collect()]
    assert one == {(q, i) for q in range(0, 20, 2) for i in range(20) if i != q} == set(two) and len(two) == len(one)
