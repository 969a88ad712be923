"""Queries of sparse cells, splits, panels, networks and the layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import evalml, layout, similarity, sparse, styling
from ..sources import records
from .registry import NATIONS, PV, SCORES, nations, p_values, q6, query, table

_CELLS = "c AS (SELECT l_linenumber AS i, l_returnflag AS j, count(*) * 1e0 AS v FROM lineitem GROUP BY 1, 2)"


def _cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


@query("diagonal_scale", f"WITH {_CELLS}, d AS (SELECT i, 1e0 / sum(v) AS d FROM c GROUP BY 1), e AS (SELECT j, sum(v) AS d FROM c GROUP BY 1) SELECT c.i, c.j, {q6('v * d.d * e.d')} AS v FROM c JOIN d ON d.i = c.i JOIN e ON e.j = c.j")
def _(spark, d):
    c = _cells(spark, d)
    left = c.groupBy(F.col("i").alias("k")).agg((1 / F.sum("v")).alias("d"))
    right = c.groupBy(F.col("j").alias("k")).agg(F.sum("v").alias("d"))
    return sparse.scale(sparse.scale(c, left), right, "right").withColumn("v", nulls.q6(F.col("v")))


@query("set_cell", f"WITH {_CELLS} SELECT i, j, CASE WHEN i = 2 AND j = 'A' THEN 5e-1 ELSE v END AS v FROM c WHERE NOT (i = 3 AND j = 'N')")
def _(spark, d):
    return sparse.set_cell(sparse.set_cell(_cells(spark, d), 2, "A", 0.5), 3, "N", 0)


@query("sparse_products", f"WITH {_CELLS}, a AS (SELECT j, v FROM c WHERE i = 1), b AS (SELECT j, v FROM c WHERE i = 2) SELECT sum(a.v * b.v) AS dot, {q6('sqrt(sum((a.v - b.v) * (a.v - b.v)))')} AS distance FROM a JOIN b ON a.j = b.j")
def _(spark, d):
    c = _cells(spark, d)
    row = lambda k: c.where(F.col("i") == k).select(F.col("j").alias("i"), "v")
    return sparse.dot(row(1), row(2)).crossJoin(sparse.euclid(row(1), row(2)).select(nulls.q6(F.col("distance")).alias("distance")))


@query("elementwise_product", f"WITH {_CELLS} SELECT i, j, v * v AS v FROM c")
def _(spark, d):
    c = _cells(spark, d)
    return sparse.elementwise(c, c)


@query("select_columns_means", f"WITH {_CELLS} SELECT CASE j WHEN 'R' THEN 0 ELSE 1 END AS j, {q6('sum(v) / 7')} AS mean FROM c WHERE j IN ('R', 'A') AND i <= 5 GROUP BY 1")
def _(spark, d):
    some = sparse.select(sparse.select(_cells(spark, d), [1, 2, 3, 4, 5]), cols=["R", "A"], compact=True)
    return sparse.column_means(some, 7).select("j", nulls.q6(F.col("mean")).alias("mean"))


@query("two_class_metrics", f"""WITH t AS (SELECT DISTINCT l.doc_id, n_chars AS score, quality = 1 AS truth FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
 b AS (SELECT score, sum(CASE WHEN truth THEN 1 ELSE 0 END) AS p, sum(CASE WHEN truth THEN 0 ELSE 1 END) AS n FROM t GROUP BY 1), s AS (SELECT sum(p) AS p, sum(n) AS n FROM b),
 k AS (SELECT b.score, sum(b.p) OVER w * 1e0 / s.p AS y, sum(b.n) OVER w * 1e0 / s.n AS x, b.p * 1e0 / s.p AS dy, b.n * 1e0 / s.n AS dx FROM b, s WINDOW w AS (ORDER BY b.score DESC)),
 r AS (SELECT truth, row_number() OVER (ORDER BY score DESC, doc_id) AS i, sum(CASE WHEN truth THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM t)
 SELECT (SELECT {q6('sum(dx * (y - dy / 2))')} FROM k) AS auc1, (SELECT {q6('avg(tp * 1e0 / i)')} FROM r WHERE truth) AS ap1, (SELECT arg_max(score, {{'a': y - x, 'b': score}}) FROM k) AS threshold1, (SELECT p::BIGINT FROM s) AS n_true, (SELECT n::BIGINT FROM s) AS n_false""")
def _(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("truth")).distinct()
    return evalml.two_class_metrics(t, "score", "truth", "doc_id").select(nulls.q6(F.col("auc1")).alias("auc1"), nulls.q6(F.col("ap1")).alias("ap1"), "threshold1", "n_true", "n_false")


_HASH = "({} * 2654435761) % 4294967296"


@query("split_once", f"SELECT o_orderkey, {_HASH.format('o_orderkey')} < 0.7e0 * 4294967296 AS train FROM orders")
def _(spark, d):
    return evalml.split_once(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.7)


@query("split_by_group", f"SELECT o_orderkey, o_custkey, {_HASH.format('(o_custkey + 3)')} < 0.5e0 * 4294967296 AS train FROM orders")
def _(spark, d):
    return evalml.split_by_group(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.5, 3)


@query("leave_k_out", f"SELECT s_suppkey, (row_number() OVER (ORDER BY {_HASH.format('s_suppkey')}, s_suppkey) - 1) // 7 AS fold FROM supplier")
def _(spark, d):
    return evalml.leave_k_out(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 7)


@query("premade_folds", "SELECT c_custkey, n_regionkey::BIGINT AS fold FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    folds = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("fold"))
    return evalml.premade_folds(table(spark, d, "customer").select("c_custkey", "c_nationkey"), folds, "c_nationkey").select("c_custkey", "fold")


@query("fold_counts", "SELECT n_regionkey::BIGINT AS fold, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS positive FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(spark, d):
    folds = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("fold"))
    rows = evalml.premade_folds(table(spark, d, "customer"), folds, "c_nationkey")
    return evalml.evaluate(rows, "fold", 5, lambda r: r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"))).where("n > 0")


@query("cell_highlight", "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal > 9000 THEN 'high' END AS c_acctbal_mark FROM customer")
def _(spark, d):
    return styling.highlight(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 0, 9000)


@query("style_rules", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'red' WHEN c_mktsegment = 'BUILDING' THEN 'blue' ELSE 'grey' END AS background_color, CASE WHEN c_mktsegment = 'BUILDING' THEN '2' ELSE '1' END AS width FROM customer")
def _(spark, d):
    rules = [(None, None, {"background-color": "grey", "width": 1}), ("c_mktsegment", "BUILDING", {"background-color": "blue", "width": 2}), ("c_nationkey", 3, {"background-color": "red"})]
    return styling.style(table(spark, d, "customer"), rules).select("c_custkey", "background_color", "width")


@query("rank_panel", f"WITH {PV}, r AS (SELECT screen, gene, p, row_number() OVER (PARTITION BY screen ORDER BY p, gene) AS rank FROM pv) SELECT screen, gene, rank, {q6('-log10(p)')} AS neglog, p < 5e-2 AS hit, CASE WHEN rank <= 10 THEN {q6('4.5e0 - (rank - 1) * 0.4e0')} END AS label_y FROM r")
def _(spark, d):
    return styling.rank_panel(p_values(spark, d), ["screen"], "gene", "p").select("screen", "gene", "rank", nulls.q6(F.col("neglog")).alias("neglog"), "hit", nulls.q6(F.col("label_y")).alias("label_y"))


@query("dot_sizes", f"WITH {PV} SELECT screen, gene, {q6('least(-log10(p), 2e0)')} AS size, {q6('least(-log10(p), 2e0) / 2e0')} AS alpha FROM pv")
def _(spark, d):
    return styling.dots(p_values(spark, d), ["screen", "gene"], "p", 2.0).select("screen", "gene", nulls.q6(F.col("size")).alias("size"), nulls.q6(F.col("alpha")).alias("alpha"))


@query("network_nodes", f"WITH {NATIONS}, k AS (SELECT src AS id, count(*) AS n FROM b GROUP BY 1) SELECT id, n AS colour, {q6('sqrt(n)')} AS size, CASE WHEN n > 3 OR id IN (1, 2) THEN id::VARCHAR ELSE '' END AS label FROM k")
def _(spark, d):
    e, _n = nations(spark, d)
    k = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return styling.network_nodes(k, "id", "n", ["1", "2"]).select("id", "colour", nulls.q6(F.col("size")).alias("size"), "label")


@query("area_pieces", "WITH k AS (SELECT p_brand, lag(p_size) OVER w AS x0, lag(p_retailprice) OVER w AS top0, lag(0e0) OVER w AS low0, p_size AS x1, p_retailprice AS top1, 0e0 AS low1 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) SELECT * FROM k WHERE x0 IS NOT NULL")
def _(spark, d):
    return styling.area(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_size", "p_retailprice")


@query("layer_bounds", "SELECT least((SELECT min(p_size) FROM part), (SELECT min(s_nationkey) FROM supplier))::DOUBLE AS x_lo, greatest((SELECT max(p_size) FROM part), (SELECT max(s_nationkey) FROM supplier))::DOUBLE AS x_hi, least((SELECT min(p_retailprice) FROM part), (SELECT min(s_acctbal) FROM supplier)) AS y_lo, greatest((SELECT max(p_retailprice) FROM part), (SELECT max(s_acctbal) FROM supplier)) AS y_hi")
def _(spark, d):
    return styling.layer_bounds([(table(spark, d, "part"), ["p_size", "p_retailprice"]), (table(spark, d, "supplier"), ["s_nationkey", "s_acctbal"])], ["x", "y"])


@query("bezier_points", f"WITH p AS (SELECT c_custkey, k / 8e0 AS t, c_nationkey * 1e0 AS a, c_acctbal AS b FROM customer, range(0, 9) r(k)) SELECT c_custkey, t, {q6('3 * (1 - t) * t * t * a + t * t * t * b')} AS x, {q6('(1 - t) * (1 - t) * (1 - t) * b + t * t * t * a')} AS y FROM p")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("a"), F.col("c_acctbal").alias("b"), F.lit(0.0).alias("o"))
    return styling.bezier(c, ["c_custkey"], [("o", "b"), ("o", "o"), ("a", "o"), ("b", "a")]).select("c_custkey", "t", nulls.q6(F.col("x")).alias("x"), nulls.q6(F.col("y")).alias("y"))


@query("projected_points", f"SELECT p_partkey, {q6('CASE WHEN p_retailprice - 1000 > 0 THEN (2e0 * p_size + 1) / (p_retailprice - 1000) END')} AS x, {q6('CASE WHEN p_retailprice - 1000 > 0 THEN (p_partkey % 100) * 1e0 / (p_retailprice - 1000) END')} AS y, {q6('p_retailprice - 1000')} AS depth FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 100).alias("r"), "p_retailprice")
    got = styling.project(p, ["p_partkey"], ("p_size", "r", "p_retailprice"), [[2.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, -1000.0]])
    return got.select("p_partkey", *[nulls.q6(F.col(c)).alias(c) for c in ("x", "y", "depth")])


@query("pathway_collection", "SELECT DISTINCT regexp_replace(p_brand || '_' || p_type, '^[^_]*_', '') AS set_, p_partkey AS member FROM part WHERE p_size = 7")
def _(spark, d):
    p = table(spark, d, "part").select(F.concat_ws("_", "p_brand", "p_type").alias("name"), F.col("p_size").cast("string").alias("category"), F.lit("").alias("subcategory"), F.col("p_partkey").alias("member"))
    return records.pathway_collection(p, "7").withColumnRenamed("set", "set_")


@query("named_set", "SELECT p_partkey AS member FROM part WHERE p_brand = 'Brand#11'")
def _(spark, d):
    return records.gene_set(table(spark, d, "part").select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("member")), "Brand#11")


@query("graph_object", f"WITH {NATIONS} SELECT src, dst, {q6('w')} AS w, CASE WHEN src = 4 THEN 'red' END AS line_color FROM g WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2) OR n_nationkey IN (0, 4)) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2) OR n_nationkey IN (0, 4))")
def _(spark, d):
    e, _n = nations(spark, d)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("name"), F.col("n_regionkey").cast("string").alias("type"))
    _nodes, edges = records.graph_object(n, e, ["1", "2"], ["0", "4"], [("src", 4, {"line-color": "red"})])
    return edges.select("src", "dst", nulls.q6(F.col("w")).alias("w"), "line_color")


@query("csv_payload", """SELECT c_custkey || ',' || CASE WHEN contains(c_name, ',') OR contains(c_name, '"') THEN '"' || replace(c_name, '"', '""') || '"' ELSE c_name END || ',' || c_mktsegment AS value FROM customer""")
def _(spark, d):
    return records.csv_lines(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("html_rows", "SELECT '<tr><td>' || n_nationkey || '</td><td>' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS value FROM nation")
def _(spark, d):
    return records.html_rows(table(spark, d, "nation"), ["n_nationkey", "n_name"])


@query("leading_edge", f"""WITH {SCORES}, g AS (SELECT gene, max(score) AS stat FROM s GROUP BY 1), k AS (SELECT gene, stat, p_brand AS brand, row_number() OVER (ORDER BY stat DESC, gene) AS pos, count(*) OVER () AS n FROM g JOIN part ON p_partkey = gene),
 h AS (SELECT brand, gene, pos, n, sum(stat) OVER (PARTITION BY brand ORDER BY pos) * 1e0 / sum(stat) OVER (PARTITION BY brand) AS hit, row_number() OVER (PARTITION BY brand ORDER BY pos) AS i, count(*) OVER (PARTITION BY brand) AS m FROM k),
 e AS (SELECT brand, arg_max(pos, {{'a': floor((hit - (pos - i) * 1e0 / (n - m)) * 1e9), 'b': -pos}}) AS last FROM h GROUP BY 1) SELECT h.brand, h.gene FROM h JOIN e ON e.brand = h.brand WHERE pos <= last""")
def _(spark, d):
    from ..operators import evidence, plotrows

    g = evidence.screen_scores(table(spark, d, "lineitem")).groupBy("gene").agg(F.max("score").alias("stat"))
    g = g.join(table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand")), "gene")
    r = plotrows.places(g.withColumn("_s", -F.col("stat")), [], ["_s", "gene"]).withColumn("pos", F.col("ordinal") + 1)
    n = r.count()
    return similarity.leading_edge(r.withColumn("n", F.lit(n)), ["brand"]).select("brand", "gene")


def bands(spark, d):
    """set, member: bands of what a part sold for in all screens, within 2000 keys: those at both ends stand out in most screens."""
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.sum("l_extendedprice").alias("sold"))
    return sold.select(F.expr("concat(cast(floor(sold / 150000) as string), '-', member div 2000)").alias("set"), "member")


@query("recurrent_gsea")
def _(spark, d):
    from .matrices import _ranked_z

    return similarity.recurrent_sets(similarity.gsea(_ranked_z(spark, d), bands(spark, d)))


def _near(spark, d):
    e = table(spark, d, "embeddings")
    return evalml.knn_blocks(e, e, "vec_id", "embedding", 15)


@query("fuzzy_edges")
def _(spark, d):
    return layout.fuzzy_edges(_near(spark, d))


@query("layout_2d")
def _(spark, d):
    return layout.layout_2d(layout.fuzzy_edges(_near(spark, d)), table(spark, d, "embeddings"), "vec_id")
