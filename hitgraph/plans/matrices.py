"""Queries of matrices, distances, orders, embeddings and learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls, stats
from ..operators import evalml, frames, graph, linear, pairs, plotrows, ranks, similarity
from .registry import NATIONS, PV, nations, p_values, q6, query, same, table

_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_PAIRS = "q AS (SELECT vec_id AS a, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)"


@query("sq_euclid", f"WITH {_PAIRS} SELECT a, vec_id AS b, {q6(_D2.format(a='v', b='embedding'))} AS d2 FROM q JOIN embeddings ON a <> vec_id")
def _(spark, d):
    e = table(spark, d, "embeddings")
    got = pairs.measured(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "squared_distance").withColumnsRenamed({"query": "a", "vec_id": "b"})
    return got.select("a", "b", nulls.q6(F.col("d2")).alias("d2"))


_VV, _WW, _VW = _DOT.format(a="v", b="v"), _DOT.format(a="embedding", b="embedding"), _DOT.format(a="v", b="embedding")


@query("cosine", f"WITH q AS (SELECT vec_id AS a, embedding AS v FROM embeddings) SELECT a, vec_id AS b, {q6(f'{_VW} / (sqrt({_VV}) * sqrt({_WW}))')} AS cosine, {q6(f'{_VW} / ({_VV} * {_WW})')} AS raw FROM q JOIN embeddings ON a <> vec_id")
def _(spark, d):
    e = table(spark, d, "embeddings")
    got = pairs.measured(e, e, "vec_id", "embedding", "cosine").withColumnsRenamed({"query": "a", "vec_id": "b"})
    return got.select("a", "b", nulls.q6(F.col("cosine")).alias("cosine"), nulls.q6(F.col("raw")).alias("raw"))


@query("jaccard_sets", f"WITH c AS (SELECT DISTINCT l_linenumber AS i, l_partkey AS j FROM lineitem), n AS (SELECT i, count(*) AS n FROM c GROUP BY 1) SELECT x.i AS a, y.i AS b, {q6('count(*) * 1e0 / (max(na.n) + max(nb.n) - count(*))')} AS jaccard FROM c x JOIN c y ON x.j = y.j JOIN n na ON na.i = x.i JOIN n nb ON nb.i = y.i GROUP BY 1, 2")
def _(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("j"))
    return similarity.jaccard_sets(c).withColumn("jaccard", nulls.q6(F.col("jaccard")))


# the default stop rule: the first of 5 to 100 steps whose mean squared residual is below 1e-3
_STEP = (
    "w{k} AS MATERIALIZED (SELECT b.src AS id, sum(w * v) AS w FROM b JOIN v{j} ON b.dst = v{j}.id GROUP BY 1), e{k} AS MATERIALIZED (SELECT sum(v * w{k}.w) AS value, sqrt(sum(w{k}.w * w{k}.w)) AS length FROM v{j} JOIN w{k} ON w{k}.id = v{j}.id), "
    "r{k} AS MATERIALIZED (SELECT {k} AS k, avg((w{k}.w - value * v) * (w{k}.w - value * v)) AS rest FROM v{j} JOIN w{k} ON w{k}.id = v{j}.id, e{k}), v{k} AS MATERIALIZED (SELECT id, w / length AS v FROM w{k}, e{k})"
)
_POWER = ", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, 101))
_RESTS, _VECTORS = (" UNION ALL ".join(x.format(k=k) for k in range(5, 101)) for x in ("SELECT k, rest FROM r{k}", "SELECT {k} AS k, id, v FROM v{k}"))


@query("power_iteration", f"WITH {NATIONS}, v0 AS MATERIALIZED (SELECT src AS id, 1e0 / sqrt(count(*) OVER ()) AS v FROM deg), {_POWER}, stop_at AS (SELECT coalesce(min(CASE WHEN rest < 1e-3 THEN k END), 100) AS k FROM ({_RESTS})) SELECT id, {q6('v')} AS v FROM ({_VECTORS}) x WHERE k = (SELECT k FROM stop_at)")
def _(spark, d):
    e, _n = nations(spark, d)
    both = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return similarity.power_iteration(both).select("id", nulls.q6(F.col("v")).alias("v"))


_CELLS = "SELECT l_linenumber AS i, l_returnflag AS j, count(*) * 1e0 AS v FROM lineitem GROUP BY 1, 2"


def _cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


@query("unique_cell_check", _CELLS)
def _(spark, d):
    return similarity.unique_cells(_cells(spark, d))


@query("sparse_dense_roundtrip", _CELLS)
def _(spark, d):
    return similarity.sparse(similarity.dense(_cells(spark, d), ["A", "N", "R"]), ["A", "N", "R"])


@query("standardise_pipeline", "WITH m AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS s, avg(p_retailprice) AS b, stddev_samp(p_retailprice) AS t FROM part) SELECT p_partkey, " + f"{q6('(p_size - a) / s')} AS p_size, {q6('(p_retailprice - b) / t')} AS p_retailprice FROM part, m")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    cols = ["p_size", "p_retailprice"]
    return similarity.Standardiser(cols).fit(p).transform(p).select("p_partkey", *[nulls.q6(F.col(c)).alias(c) for c in cols])


@query("binarise_weight", "WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, sum(l_discount) AS w FROM lineitem GROUP BY 1, 2) SELECT a, b, CASE WHEN w > 0 THEN 1 ELSE 0 END AS w FROM e")
def _(spark, d):
    return frames.binarise(table(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "a", "l_suppkey": "b"}), ["a", "b"], "l_discount")


same("round_display", "SELECT p_partkey, floor(p_retailprice * 10 + 0.5e0) / 10 AS price FROM part")


@query("random_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_linenumber ORDER BY ((l_orderkey * 8 + l_linenumber) * 2654435761) % 4294967296, l_orderkey, l_partkey) AS i, l_partkey FROM lineitem")
def _(spark, d):
    k = table(spark, d, "lineitem").withColumn("h", evalml.hash_order(F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    return ranks.numbered(k, ["l_linenumber"], ["h", "l_orderkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "i", "l_partkey")


@query("sort_value_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders")
def _(spark, d):
    return plotrows.places(table(spark, d, "orders"), [], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "ordinal")


@query("argsort_desc", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS ordinal, o_orderkey AS idx FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", "o_orderkey", (-F.col("o_orderkey")).alias("back"))
    return plotrows.places(o, [], ["o_totalprice", "back"], True).select("ordinal", F.col("o_orderkey").alias("idx"))


@query("recurrent_sets", f"WITH {PV}, r AS (SELECT screen, p_brand AS brand, least(min(p) * count(*), 1e0) AS padj FROM pv JOIN part ON p_partkey = gene GROUP BY 1, 2), o AS (SELECT brand, count(*) AS recurs FROM r WHERE padj < 5e-2 GROUP BY 1 HAVING count(*) > 3) SELECT screen, r.brand AS set_, {q6('padj')} AS padj, recurs FROM r JOIN o ON o.brand = r.brand")
def _(spark, d):
    pv = p_values(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("set")), "gene")
    r = pv.groupBy("screen", "set").agg(F.least(F.min("p") * F.count(F.lit(1)), F.lit(1.0)).alias("padj"))
    return similarity.recurrent_sets(r).select("screen", F.col("set").alias("set_"), nulls.q6(F.col("padj")).alias("padj"), "recurs")


def _ranked_z(spark, d):
    """comparison, gene, stat, pos, n: by screen the genes by the size of their normal quantile."""
    z = p_values(spark, d).select(F.col("screen").alias("comparison"), "gene", F.abs(stats.qnorm("least(p, 1 - 1e-9)")).alias("stat"))
    o = z.withColumn("o", F.struct(-F.col("stat"), F.col("gene")))
    return ranks.with_rank(o, ["comparison"], "o").select("comparison", "gene", "stat", F.col("rank").alias("pos"), F.col("group_size").alias("n"))


def _gene_sets(spark, d):
    """set, member: a brand's parts within 2000 keys, some 60 to 110 genes however many parts there are."""
    return table(spark, d, "part").select(F.expr("concat(p_brand, '-', p_partkey div 2000)").alias("set"), F.col("p_partkey").alias("member"))


@query("gsea_full")
def _(spark, d):
    return similarity.gsea(_ranked_z(spark, d), _gene_sets(spark, d))


@query("pca_screens")
def _(spark, d):
    z = p_values(spark, d).select(F.col("screen").alias("i"), F.col("gene").alias("j"), stats.qnorm("least(p, 1 - 1e-9)").alias("v"))
    return linear.pca(z)


@query("mashup_embedding")
def _(spark, d):
    e, n = nations(spark, d)
    return graph.mashup([e], n)


@query("rf_cv")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("target"))
    return evalml.forest_cv(e, "vec_id", "embedding", "target")


@query("profile_assembly", f"""WITH {PV}, {NATIONS}, picked AS (SELECT gene, count(*) AS n, max(-log10(p)) AS top FROM pv WHERE p < 0.5e0 GROUP BY 1 HAVING count(*) > 1), x AS (SELECT gene, top, coalesce(degree, 0e0) AS d, degree IS NOT NULL AS in_graph FROM picked LEFT JOIN deg ON deg.src = gene % 25),
 st AS (SELECT avg(top) AS a, stddev_samp(top) AS sa, avg(d) AS b, stddev_samp(d) AS sb FROM x) SELECT gene, {q6('(top - a) / sa')} AS score, {q6('(d - b) / sb')} AS degree, in_graph FROM x, st""")
def _(spark, d):
    e, _n = nations(spark, d)
    deg = e.select("src", "w").union(e.select("dst", "w")).groupBy(F.col("src").cast("long").alias("node")).agg(F.sum("w").alias("degree"))
    g = p_values(spark, d).where("p < 0.5").groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max(-F.log10("p")).alias("score")).where("n > 1")
    x = g.withColumn("node", F.col("gene") % 25).join(deg, "node", "left").select("gene", "score", F.coalesce("degree", F.lit(0.0)).alias("degree"), F.col("degree").isNotNull().alias("in_graph"))
    x = similarity.Standardiser(["score", "degree"]).fit(x).transform(x)
    return x.select("gene", nulls.q6(F.col("score")).alias("score"), nulls.q6(F.col("degree")).alias("degree"), "in_graph")
