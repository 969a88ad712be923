import math
import statistics

import pytest
from pyspark.sql import functions as F

from hitgraph.functions import nulls, stats
from hitgraph.operators import evalml, evidence, graph, ids, plotdata, ranks, tables
from hitgraph.sources import files

near = lambda x: pytest.approx(x, rel=1e-12)

SCORES = [0.9, 0.8, 0.7, 0.6, 0.55, 0.54, 0.53, 0.52, 0.51, 0.505, 0.4, 0.39, 0.38, 0.37, 0.36, 0.35, 0.34, 0.33, 0.3, 0.1]
TRUTH = [True, True, False, True, True, True, False, False, True, False, True, False, True, False, False, False, True, False, True, False]


def test_fisher_goldens(spark):
    rows = [(1, 0.9), (2, 0.9), (2, 0.9), (3, 0.9), (3, 0.9), (3, float("nan")), (4, 0.5), (4, 1e-10)]
    got = dict(spark.createDataFrame(rows, "k int, p double").groupBy("k").agg(stats.fisher(F.col("p")).alias("p")).collect())
    assert [got[k] for k in (1, 2, 3, 4)] == [near(0.9), near(0.9806840353656787), near(0.9806840353656787), near(1.235949905525023e-9)]


def test_roc_and_precision_goldens(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(SCORES, TRUTH))], "id int, s double, t boolean")
    assert evalml.average_precision(df, "s", "t", "id").first().ap == near(0.7357475805927819)
    curve = evalml.roc_curve(df, "s", "t")
    assert evalml.auc(curve).first().auc == near(0.68)
    assert evalml.auc(curve, 0.1, False).first().auc == near(0.02)
    assert evalml.auc(curve, 0.15, False).first().auc == near(0.045)
    ten = [True, False, True, False, False, True, False, False, True, True]
    df = spark.createDataFrame([(i, float(10 - i), t) for i, t in enumerate(ten)], "id int, s double, t boolean")
    assert evalml.average_precision(df, "s", "t", "id").first().ap == near(0.6222222222222221)


def test_an_empty_class_raises(spark):
    with pytest.raises(Exception, match="one class is empty"):
        evalml.roc_curve(spark.createDataFrame([(1.0, True)], "s double, t boolean"), "s", "t").collect()


def test_qnorm_is_the_normal_quantile(spark):
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.7, 0.999, 1 - 1e-9]
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(stats.qnorm("p").alias("z")).collect()]
    assert got == [pytest.approx(statistics.NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12) for p in ps]


def test_safe_arithmetic(spark):
    r = spark.range(1).select(nulls.safe_ln(F.lit(0.0)).alias("a"), nulls.safe_div(F.lit(1), F.lit(0)).alias("b"), nulls.safe_div(F.lit(0), F.lit(0)).alias("c"), nulls.nan_to_null(F.lit(float("nan"))).alias("d"), nulls.q6(F.lit(0.2850005)).alias("e")).first()
    assert r.a == -math.inf and r.b == math.inf and r.c is None and r.d is None and r.e == 0.285001


def test_percentile_type_6(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],), ([5.0],)], "v array<double>")
    assert [r[0] for r in v.select(stats.percentile6(F.col("v"), 0.25)).collect()] == [1.25, 5.0]


def test_ranks_with_ties_and_nulls(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", None), ("b", 2.0)]
    got = {(r.g, r.x): (r.rank_min, r.rank_avg, r.group_size) for r in ranks.ranked(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 3).collect()}
    assert got == {("a", 1.0): (1, 1.5, 3), ("a", 3.0): (3, 3.0, 3), ("b", 2.0): (1, 1.0, 1)}


def test_bh_is_monotone(spark):
    df = spark.createDataFrame([("g", p) for p in (0.01, 0.02, 0.03, 0.5, 0.9, 0.9)], "g string, p double")
    got = [r.padj for r in evidence.bh_adjust(df, ["g"]).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == near(0.06) and got[-1] == near(0.9)
    assert evidence.bh_cutoff(df, 0.07).first().cutoff == 0.03


def graph5(spark):
    return spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0), ("c", "c", 2.0), ("d", "a", 0.0)], "src string, dst string, w double"), spark.createDataFrame([(x,) for x in "abcde"], "id string")


def test_stochastic_matrix_and_walk(spark):
    e, n = graph5(spark)
    m = graph.stochastic(e, n)
    got = {(r.src, r.dst): r.w for r in m.collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 0.25, ("b", "c"): 0.75, ("c", "b"): 0.6, ("c", "c"): 0.4, ("d", "d"): 1.0, ("e", "e"): 1.0}
    p = graph.walk(m, n.select("id", F.when(F.col("id") == "a", 1.0).otherwise(0.0).alias("p")), 15, 0.5)
    vec = {r.id: r.p for r in p.collect()}
    want = dict.fromkeys("abcde", 0.0) | {"a": 1.0}
    start = dict(want)
    for _ in range(15):
        new = {k: 0.5 * start[k] for k in want}
        for (s, t), w in got.items():
            new[t] += 0.5 * w * want[s]
        want = new
    assert all(vec[k] == pytest.approx(want[k], abs=1e-12) for k in want) and sum(vec.values()) == near(1.0)
    assert set(r.src for r in graph.stochastic(e, n, drop_isolated=True).collect()) == set("abc")


def test_conflicting_pairs_raise(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0)], "src string, dst string, w double")
    with pytest.raises(Exception, match="two weights"):
        graph.canonical_pairs(df).collect()


def test_ids(spark):
    pairs = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "1"), ("y", "2")], "s string, t string")
    assert [tuple(r) for r in ids.one_to_one(pairs, "s", "t").collect()] == [("x", "1")]
    m = spark.createDataFrame([("k", "a", 0), ("k", "b", 1), ("", "c", 2)], "key string, value string, at int")
    assert [tuple(r) for r in ids.last_wins(m, "key", "value", "at").collect()] == [("k", "b")]


def test_table_query(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", "x"), ("d", None)], "k string, v string")
    assert [r.k for r in tables.TableQuery(["k"], sort="v").run(df).collect()] == ["b", "a", "d", "c"]
    assert [r.k for r in tables.TableQuery(["k"], sort="v", descending=True).run(df).collect()] == ["c", "d", "a", "b"]
    assert [r.k for r in tables.TableQuery(["k"], "[AB]", True, page=1, page_size=1).run(df).collect()] == ["b"]


def test_histogram_and_hexbin_totals(spark):
    df = spark.range(100).select((F.col("id") / 99 * 10).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert plotdata.histogram(df, "x", 0.0, 1.0, 10).agg(F.sum("n")).first()[0] == 100
    assert plotdata.hexbin(df, "x", "y", 1.0, 1.0).agg(F.sum("n")).first()[0] == 100


def test_files(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("set1\tdesc\tA\tB\nset2\t\tC\n")
    assert sorted(map(tuple, files.read_gmt(spark, f"file://{tmp_path}/s.gmt").collect())) == [("set1", "A"), ("set1", "B"), ("set2", "C")]
    (tmp_path / "m.tsv").write_text("#Mouse Gene\tHuman Gene\nm1\tH1\nm1\tH2\nm2\t\n")
    assert [tuple(r) for r in files.read_ortholog_map(spark, f"file://{tmp_path}/m.tsv").collect()] == [("m1", "H2")]
    (tmp_path / "g.tsv").write_text("id\tpos|score\tneg|score\nm1\t0.5\tx\nZ\t1\t2\n")
    maps = spark.createDataFrame([("m1", "H2")], "key string, value string")
    got = sorted((r.mapped, r["pos|score"], r["neg|score"]) for r in files.read_scores(spark, f"file://{tmp_path}/g.tsv", ["pos|score", "neg|score"], maps).collect())
    assert got == [("H2", 0.5, None), ("Z", 1.0, 2.0)]
    (tmp_path / "c.tsv").write_text("Sg RNA\tCompare From\tCompare To\ng1\t1\t2\ng1\t1\t2\n")
    got = files.read_guide_counts(spark, f"file://{tmp_path}/c.tsv", "sg_rna", ["compare_from", "compare_to"], "7")
    assert sorted((r.sample, r["count"]) for r in got.collect()) == [("compare_from", 1), ("compare_to", 2)]
    files.write_bundle(f"file://{tmp_path}/b", {"edges": maps}, {"summary": maps})
    assert spark.read.json(f"file://{tmp_path}/b/summary.json").count() == 1
    files.write_tsv(maps, f"file://{tmp_path}/t", ["value"])
    assert spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/t").count() == 1
