import math

import numpy as np
from pyspark.sql import functions as F

from hitgraph.operators import preparation, similarity, tables


def loop_gsea(stats, members):
    """(score, leading members) of one set by a plain loop; stats: {gene: (pos, stat)}."""
    inside = sorted((stats[g][0], g) for g in members if g in stats)
    total = sum(stats[g][1] for _, g in inside)
    n, m, run, top, low = len(stats), len(inside), 0.0, (-2.0, 0), (2.0, 0)
    for k, (pos, g) in enumerate(inside):
        miss = (pos - k - 1) / (n - m)
        low = min(low, (round(run / total - miss, 9), k))
        run += stats[g][1]
        top = max(top, (round(run / total - miss, 9), -k))
    if top[0] >= -low[0]:
        return top[0], [g for _, g in inside[: -top[1] + 1]]
    return low[0], [g for _, g in inside[low[1] :]][::-1]


def test_leading_edges_and_recurrence_of_planted_sets(spark):
    rng = np.random.default_rng(5)
    genes = [f"g{i:03d}" for i in range(200)]
    ranked, by = [], {}
    planted = {"up": genes[:12], "down": genes[20:30], "some": genes[40:50]}
    for c in range(5):
        stat = rng.random(200)
        stat[:12] += 2  # in all five comparisons
        stat[20:30] *= 0.01
        stat[40:50] += 2 * (c < 2)  # in two only
        order = np.argsort(-stat)
        by[c] = {genes[g]: (k + 1, float(stat[g])) for k, g in enumerate(order)}
        ranked += [(c, genes[g], float(stat[g]), k + 1, 200) for k, g in enumerate(order)]
    sets = {**planted, **{f"r{k}": [genes[i] for i in rng.choice(np.arange(60, 200), 8, replace=False)] for k in range(6)}}
    ranked = spark.createDataFrame(ranked, "comparison int, gene string, stat double, pos long, n long")
    table = spark.createDataFrame([(s, g) for s, m in sets.items() for g in m], "set string, member string")
    got = similarity.gsea(ranked, table, permutations=400).cache()
    for r in got.collect():
        es, edge = loop_gsea(by[r.comparison], sets[r.set])
        assert math.isclose(r.es, es, abs_tol=1e-8) and r.edge == ", ".join(edge), r
    often = {(r.set, r.recurs) for r in similarity.recurrent_sets(got).select("set", "recurs").distinct().collect()}
    assert ("up", 5) in often and "some" not in {s for s, _ in often} and not any(s.startswith("r") for s, _ in often)


def test_sets_of_the_recurrent_query_recur(spark, sf):
    """Its binding, with fewer permutations than the query's 1000."""
    from hitgraph.plans import matrices, more

    d = sf.replace("sf0.001", "sf0.01")
    rows = similarity.recurrent_sets(similarity.gsea(matrices._ranked_z(spark, d), more.bands(spark, d), permutations=300)).collect()
    assert rows and all(r.recurs > 3 for r in rows) and all(r.edge for r in rows)


def test_harmonise_by_hand(spark):
    scores = spark.createDataFrame([(1, "human", "TP53"), (2, "mouse", "Trp53"), (3, "mouse", "Nope"), (4, "monkey", "OLDP53"), (5, "monkey", "X1"), (6, "fly", "p53"), (7, "human", None)], "id long, species string, gene string")
    mouse = spark.createDataFrame([("Trp53", "TP53")], "source string, target string")
    typed = spark.createDataFrame([("X1", "Y1", "ortholog_one2one"), ("X1", "Y1", "ortholog_one2one"), ("X2", "Y2", "ortholog_one2many"), ("X3", "a", "ortholog_one2one"), ("X3", "b", "ortholog_one2one"), ("", "c", "ortholog_one2one")], "source string, target string, kind string")
    monkey = preparation.orthologs_of_type(typed, "source", "target", "kind")
    assert [tuple(r) for r in monkey.collect()] == [("X1", "Y1")]
    aliases = spark.createDataFrame([("OLDP53", "TP53"), ("Y1", "Z1"), ("p53", "A"), ("p53", "B"), ("TP53", "WRONG")], "alias string, symbol string")
    got = {r.id: r.symbol for r in preparation.harmonise(scores, "species", "gene", "human", {"mouse": mouse, "monkey": monkey}, aliases).collect()}
    assert got == {1: "TP53", 2: "TP53", 3: "Nope", 4: "TP53", 5: "Z1", 6: "p53", 7: None}


def test_components_of_screens_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(s, g, float(rng.integers(0, 40)) + g, s == 0 and g % 2 == 0) for s in range(5) for g in range(60) if (s, g) != (2, 7)]
    df = spark.createDataFrame(rows, "screen int, gene int, score double, hit boolean")
    cells = preparation.screen_cells(df, "screen", "gene", "score", F.col("hit")).toPandas()
    assert sorted(cells.j.unique()) == list(range(0, 60, 2))
    m = cells.pivot(index="i", columns="j", values="v").to_numpy()
    assert np.isfinite(m).all()
    x = m - m.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    scores, loadings = preparation.screen_components(spark.createDataFrame(cells), 2)
    got = scores.toPandas().pivot(index="i", columns="component", values="score").to_numpy()
    w = loadings.toPandas().pivot(index="j", columns="component", values="loading").to_numpy()
    for c in range(2):
        sign = np.sign(got[:, c] @ (u[:, c] * s[c]))
        assert np.allclose(got[:, c], sign * u[:, c] * s[c], atol=1e-8) and np.allclose(w[:, c], sign * vt[c], atol=1e-8)
    ends = preparation.extreme_loadings(loadings, 1, 3).collect()
    order = np.argsort(w[:, 0])
    names = np.array(sorted(cells.j.unique()))
    assert {r.j for r in ends if r.side == "low"} == set(names[order[:3]]) and {r.j for r in ends if r.side == "high"} == set(names[order[-3:]])
    placed = {r.place: r.j for r in preparation.by_absolute_rank(loadings, 1).collect()}
    assert placed[0] == names[np.abs(w[:, 0]).argmax()] and len(placed) == 30


def test_small_table_operators(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.0), ("b", 0.25), ("b", 1.0), ("c", None)], "k string, p double")
    assert {r.k: r.p for r in tables.geometric_mean(df, ["k"], "p").collect()} == {"a": 0.0, "b": 0.5, "c": None}
    assert sorted(r.p for r in tables.clamp_below(df.where("k = 'b'"), "p", 1.0).collect()) == [0.25, 0.25]
    assert {r.k: r.n for r in tables.count_if_rows(df, ["k"], F.col("p") < 0.3).collect()} == {"a": 1, "b": 1}
    asked = spark.createDataFrame([(2, "b"), (0, "x"), (1, "a"), (3, "a")], "place long, k string")
    assert [tuple(r) for r in tables.lookup_in_order(asked, "k", spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")).collect()] == [(0, "x", None), (1, "a", 1), (2, "b", 2), (3, "a", 1)]
