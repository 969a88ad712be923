"""The queries by name, and the same in SQL for comparison.

Where both engines read one text alike it is written once (`same`); the other queries call the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls, stats
from ..operators import axes, evalml, evidence, frames, graph, ids, linear, plotdata, ranks, tables
from ..sources import files
from . import learned, matrices, more, plots  # noqa: F401  they add their queries
from .registry import CUT, COMB, NATIONS, ORACLE, PV, QUERIES, SCORES, TABLES, nations, p_values, q6, query, same, table  # noqa: F401
from ..operators.written import materialize


@query("combined_evidence", f"WITH {CUT}, h AS (SELECT gene, count(*) FILTER (WHERE p <= cutoff) AS n_hits FROM comb, c GROUP BY 1) SELECT n_hits, count(*) AS genes FROM h GROUP BY 1")
def _(spark, d):
    return evidence.combined_evidence(table(spark, d, "lineitem"))


ORACLE["pathogen_count_summary"] = ORACLE["combined_evidence"]
QUERIES["pathogen_count_summary"] = QUERIES["combined_evidence"]


@query("fisher_combine", f"WITH {COMB} SELECT pathogen::BIGINT AS pathogen, gene, k, {q6('p')} AS p6 FROM comb")
def _(spark, d):
    ps = p_values(spark, d).withColumn("pathogen", F.expr("cast(screen % 3 as bigint)"))
    return evidence.fisher_combine(ps, ["pathogen", "gene"]).select("pathogen", "gene", "k", nulls.q6(F.col("p")).alias("p6"))


@query("bh_cutoff", f"WITH {CUT} SELECT {q6('cutoff')} AS cutoff FROM c")
def _(spark, d):
    comb = materialize(evidence.fisher_combine(p_values(spark, d).withColumn("pathogen", F.expr("screen % 3")), ["pathogen", "gene"]))
    return evidence.bh_cutoff(comb, 0.05).select(nulls.q6(F.col("cutoff")).alias("cutoff"))


@query("bh_adjust", f"WITH {COMB}, a AS (SELECT *, p * count(*) OVER (PARTITION BY pathogen) / count(*) OVER (PARTITION BY pathogen ORDER BY p) AS raw FROM comb) SELECT pathogen::BIGINT AS pathogen, gene, {q6('least(1e0, min(raw) OVER (PARTITION BY pathogen ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS padj FROM a")
def _(spark, d):
    comb = evidence.fisher_combine(p_values(spark, d).withColumn("pathogen", F.expr("cast(screen % 3 as bigint)")), ["pathogen", "gene"])
    return evidence.bh_adjust(comb, ["pathogen"]).select("pathogen", "gene", nulls.q6(F.col("padj")).alias("padj"))


@query("norm_rank", f"WITH {SCORES} SELECT screen, gene, {q6('rank() OVER (PARTITION BY screen ORDER BY score) * 1e0 / count(*) OVER (PARTITION BY screen)')} AS nr FROM s")
def _(spark, d):
    r = ranks.with_rank(evidence.screen_scores(table(spark, d, "lineitem")), ["screen"], "score")
    return r.select("screen", "gene", nulls.q6(F.col("rank") / F.col("group_size")).alias("nr"))


@query("avg_rank_top100", f"WITH {SCORES}, r AS (SELECT screen, gene, rank() OVER (PARTITION BY screen ORDER BY score DESC) + (count(*) OVER (PARTITION BY screen, score) - 1) / 2e0 AS ar FROM s) SELECT screen, gene, ar FROM r WHERE ar <= 100")
def _(spark, d):
    s = evidence.screen_scores(table(spark, d, "lineitem")).withColumn("down", -F.col("score"))
    return ranks.with_rank(s, ["screen"], "down", "avg").where("rank <= 100").select("screen", "gene", F.col("rank").alias("ar"))


_HALF = "SELECT l_partkey AS id, {} AS p FROM lineitem WHERE l_linenumber {} GROUP BY 1"
@query("outer_min_p", f"WITH {PV}, a AS (SELECT gene AS id, min(p) AS p FROM pv WHERE screen <= 3 GROUP BY 1), b AS (SELECT gene AS id, min(p) AS p FROM pv WHERE screen >= 3 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, {q6('least(a.p, b.p)')} AS p FROM a FULL JOIN b ON a.id = b.id")
def _(spark, d):
    pv = materialize(p_values(spark, d))
    side = lambda c: pv.where(c).select(F.col("gene").alias("id"), "p")
    return evidence.outer_min_p(side("screen <= 3"), side("screen >= 3"), "id").select("id", nulls.q6(F.col("p")).alias("p"))


@query("score_select_direction", """WITH a AS (SELECT l_partkey AS id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS neg_score, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS pos_score,
 count(*) FILTER (WHERE l_returnflag = 'R') AS neg_good, count(*) FILTER (WHERE l_returnflag <> 'R') AS pos_good FROM lineitem GROUP BY 1), g AS (SELECT max(greatest(neg_good, pos_good)) > 1 AS ok FROM a)
 SELECT id, CASE WHEN neg_score > pos_score AND ok THEN neg_score ELSE pos_score END AS score, CASE WHEN neg_score > pos_score AND ok THEN 'neg' ELSE 'pos' END AS direction FROM a, g""")
def _(spark, d):
    flag = F.col("l_returnflag") == "R"
    a = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.sum(F.when(flag, F.col("l_quantity")).otherwise(0)).cast("long").alias("neg_score"), F.sum(F.when(~flag, F.col("l_quantity")).otherwise(0)).cast("long").alias("pos_score"),
        F.count_if(flag).alias("neg_good"), F.count_if(~flag).alias("pos_good"),
    )
    out = evidence.score_direction(materialize(a), {"score": "neg_score", "good": "neg_good"}, {"score": "pos_score", "good": "pos_good"})
    return out.select("id", F.col("best_score").alias("score"), "direction")


# projections and derivations


@query("unpivot_directions", "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price' AS what, p_retailprice AS v FROM part")
def _(spark, d):
    return frames.melt(table(spark, d, "part"), ["p_partkey"], {"size": "p_size", "price": "p_retailprice"})


same("label_derivation", "SELECT c_custkey, concat('C-', substr(c_name, 10), '/', lower(c_mktsegment)) AS label, replace(c_mktsegment, 'A', '_') AS recoded FROM customer")


@query("hit_class_labels", f"WITH {PV} SELECT screen, gene, CASE WHEN gene IN (1, 2, 3, 4) THEN 'receptor' WHEN p < 1e-2 THEN 'enriched' WHEN p > 99e-2 THEN 'depleted' ELSE 'no' END AS hit, CASE WHEN row_number() OVER (PARTITION BY screen ORDER BY score, gene) <= 10 THEN CAST(gene AS VARCHAR(20)) ELSE '' END AS label FROM pv")
def _(spark, d):
    return evidence.hit_classes(p_values(spark, d), [1, 2, 3, 4])


@query("neglog_zero_floor", f"WITH m AS (SELECT min(l_discount) AS low FROM lineitem WHERE l_discount > 0) SELECT l_orderkey, l_linenumber, {q6('-log10(CASE WHEN l_discount = 0 THEN low ELSE l_discount END)')} AS y FROM lineitem CROSS JOIN m")
def _(spark, d):
    return frames.neg_log10(table(spark, d, "lineitem"), "l_discount", "y").select("l_orderkey", "l_linenumber", nulls.q6(F.col("y")).alias("y"))


same("binary_target", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 100000 THEN 1 ELSE 0 END AS DOUBLE) AS target FROM orders")
same("log_odds", f"SELECT o_orderkey, {q6('log10((o_totalprice / 1e6) / (1 - o_totalprice / 1e6))')} AS odds FROM orders WHERE o_totalprice > 0 AND o_totalprice < 1000000")


@query("provenance_join", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS provenance FROM events GROUP BY 1")
def _(spark, d):
    return frames.provenance(table(spark, d, "events"), ["user_id"], "event_type")


@query("label_encode", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def _(spark, d):
    return frames.encode(table(spark, d, "events"), "event_type").select("event_id", "code")


same("transpose_long", "SELECT n_name AS row_key, r_name AS col_key, CAST(n_nationkey AS DOUBLE) AS v FROM nation JOIN region ON n_regionkey = r_regionkey")


@query("project_prefix_rename", "SELECT p_partkey AS id, p_brand AS pos_brand, p_type AS pos_type FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[F.col(f"p_{c}").alias(f"pos_{c}") for c in ("brand", "type")])


@query("flatten_key", "SELECT n_nationkey, split_part(n_name, 'A', 1) AS key1, CASE WHEN len(string_split(n_name, 'A')) >= 2 THEN string_split(n_name, 'A')[2] ELSE '' END AS key2, CASE WHEN len(string_split(n_name, 'A')) >= 3 THEN string_split(n_name, 'A')[3] ELSE '' END AS key3 FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", *tables.flatten_key(F.split("n_name", "A"), 3))


@query("ordered_recode", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment LIKE '%BUILD%' THEN 'build' WHEN regexp_matches(c_mktsegment, '^A') THEN 'auto' ELSE c_mktsegment END AS seg FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    seg = F.col("c_mktsegment")
    return c.select("c_custkey", tables.ordered_recode([(F.rlike(seg, F.lit("^A")), F.lit("auto")), (seg.contains("BUILD"), F.lit("build")), (F.col("c_acctbal") < 0, F.lit("debt"))], seg).alias("seg"))


# filters
same("node_subset", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') OR n_name IN ('BRAZIL', 'CANADA')")


@query("edge_subset", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 2))")
def _(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    parts = table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("id"))
    some = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey in (1, 2)"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return graph.edges_within(edges, parts, some.select(F.col("s_suppkey").alias("id"))).select(F.col("src").alias("l_partkey"), F.col("dst").alias("l_suppkey"))


same("mixed_edges", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_acctbal > 0 AND n_regionkey <> 1) OR (c_acctbal <= 0 AND n_regionkey = 1)")


@query("row_countif_filter", f"WITH {PV} SELECT gene, count(CASE WHEN p < 1e-2 THEN 1 END) AS n FROM pv GROUP BY 1 HAVING count(CASE WHEN p < 1e-2 THEN 1 END) >= 1")
def _(spark, d):
    return tables.count_if_rows(p_values(spark, d), ["gene"], F.col("p") < 1e-2, 1).select("gene", "n")


same("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount BETWEEN 5e-2 AND 7e-2 AND l_returnflag = 'R'")
same("filter_substring", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%green%' OR p_type LIKE 'PROMO%'")


@query("dropna_any", "SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return frames.drop_na(table(spark, d, "documents"), ["doc_id", "text", "source"]).select("doc_id", "text")


@query("key_member", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    return frames.members(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey")


same("nonempty", "SELECT doc_id FROM documents WHERE length(text) > 0")


@query("finite_in_range", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e308 AND value BETWEEN 10 AND 50")
def _(spark, d):
    return table(spark, d, "events").where(frames.inside({"value": (10, 50)})).select("event_id", "value")


@query("axis_clip", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 950 AND 1500")
def _(spark, d):
    return table(spark, d, "part").where(frames.inside({"p_size": (5, 40), "p_retailprice": (950, 1500)})).select("p_partkey", "p_size", "p_retailprice")


same("toc_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blue')")
same("box_selection", "WITH b AS (SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice < 1200) SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM b) GROUP BY 1")
same("tag_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green'])", "SELECT p_partkey FROM part WHERE arrays_overlap(split(p_name, ' '), array('red', 'blue', 'green'))")


@query("regex_key_filter", "SELECT p_partkey, p_name FROM part WHERE list_contains(list_transform(string_split(p_name, ' '), lambda x: regexp_full_match(x, 'B.*E|red', 'i')), true)")
def _(spark, d):
    p = table(spark, d, "part")
    return p.where(tables.regex_key_filter(F.split("p_name", " "), "B.*E|red", True)).select("p_partkey", "p_name")


@query("focus_window", "WITH a AS (SELECT max(p_size) - min(p_size) AS w, max(p_retailprice) - min(p_retailprice) AS h FROM part), m AS (SELECT min(p_size) x0, max(p_size) x1, min(p_retailprice) y0, max(p_retailprice) y1 FROM part WHERE p_name LIKE '%blue%') SELECT floor((x0 - 5e-2 * w) * 1e6 + 0.5e0) / 1e6 AS x0, floor((x1 + 5e-2 * w) * 1e6 + 0.5e0) / 1e6 AS x1, floor((y0 - 5e-2 * h) * 1e6 + 0.5e0) / 1e6 AS y0, floor((y1 + 5e-2 * h) * 1e6 + 0.5e0) / 1e6 AS y1 FROM a, m")
def _(spark, d):
    hit = F.col("p_name").contains("blue")
    lo, hi = lambda c: F.min(F.when(hit, F.col(c))), lambda c: F.max(F.when(hit, F.col(c)))
    ext = lambda c: (F.max(c) - F.min(c)) * 0.05
    x, y = "p_size", "p_retailprice"
    return table(spark, d, "part").agg(*[nulls.q6(v).alias(n) for n, v in (("x0", lo(x) - ext(x)), ("x1", hi(x) + ext(x)), ("y0", lo(y) - ext(y)), ("y1", hi(y) + ext(y)))])


@query("constant_column_drop", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7).alias("constant"))
    return p.drop(*tables.constant_columns(p, ["p_size", "p_retailprice", "constant"]))


# joins
same("inner_metadata", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
same("left_alias", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")


@query("keyed_lookup", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    return frames.reindex(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").drop("l_partkey")


@query("common_keys_all_screens", "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def _(spark, d):
    return frames.in_all_groups(table(spark, d, "lineitem"), "l_partkey", "l_linenumber")


@query("reindex_fill", "SELECT p_partkey, coalesce(q, 0) AS q FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t ON p_partkey = l_partkey")
def _(spark, d):
    return frames.reindex(
        table(spark, d, "part").select("p_partkey"), "p_partkey",
        table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q")), "l_partkey", 0,
    )


@query("outer_concat_dropna", "SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY 1) b ON a.k = b.k WHERE x IS NOT NULL AND y IS NOT NULL")
def _(spark, d):
    return frames.drop_na(frames.columns_beside([
        table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("x")),
        table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("y")),
    ], "k", "outer"))


@query("semi_anti", "SELECT c_custkey, CASE WHEN k IS NULL THEN 'new' ELSE 'known' END AS state FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey")
def _(spark, d):
    return frames.flagged(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey", "known", "new")


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return frames.without(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey").distinct()


@query("ortholog_unique", "SELECT p_name AS source, min(p_brand) AS target FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def _(spark, d):
    p = table(spark, d, "part").where("p_name is not null").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"))
    return ids.one_to_one(p, "source", "target")


_MAPS = "a AS (SELECT p_name AS k, min(p_brand) AS v FROM part WHERE p_size < 20 GROUP BY 1), b AS (SELECT p_name AS k, min(p_type) AS v FROM part WHERE p_size > 30 GROUP BY 1)"
@query("fallback_lookup", f"WITH {_MAPS} SELECT p_partkey, coalesce(a.v, b.v, p_name) AS mapped FROM part LEFT JOIN a ON a.k = p_name LEFT JOIN b ON b.k = p_name")
def _(spark, d):
    p = table(spark, d, "part")
    m = lambda c, v: p.where(c).groupBy(F.col("p_name").alias("key")).agg(F.min(v).alias("value"))
    return ids.fallback_lookup(p, "p_name", m("p_size < 20", "p_brand"), m("p_size > 30", "p_type")).select("p_partkey", "mapped")


@query("alias_standardise", "WITH ok AS (SELECT DISTINCT p_name AS s FROM part WHERE p_size < 10), al AS (SELECT p_name AS a, min(p_brand) AS s FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1) SELECT p_partkey, CASE WHEN ok.s IS NOT NULL THEN p_name ELSE coalesce(al.s, p_name) END AS standard FROM part LEFT JOIN ok ON ok.s = p_name LEFT JOIN al ON al.a = p_name")
def _(spark, d):
    p = table(spark, d, "part")
    return ids.standardise_alias(p, "p_name", p.where("p_size < 10").select(F.col("p_name").alias("symbol")), p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("symbol"))).select("p_partkey", "standard")


# aggregates
same("group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
same("distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
same("max_abs", "SELECT c_nationkey, max(abs(c_acctbal)) AS m FROM customer GROUP BY 1")


@query("hit_pivot", "SELECT l_linenumber, coalesce(min(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS a, coalesce(min(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS n, coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS r FROM lineitem GROUP BY 1")
def _(spark, d):
    return frames.pivot(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", {"A": "a", "N": "n", "R": "r"})


@query("geo_mean_folds", f"WITH {PV} SELECT gene, {q6('exp(avg(ln(p)))')} AS g FROM pv GROUP BY 1")
def _(spark, d):
    return tables.geometric_mean(p_values(spark, d), ["gene"], "p").select("gene", nulls.q6(F.col("p")).alias("g"))


@query("column_bounds", "SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS e0, max(l_extendedprice) AS e1 FROM lineitem")
def _(spark, d):
    return frames.bounds(table(spark, d, "lineitem"), {"l_quantity": ("q0", "q1"), "l_extendedprice": ("e0", "e1")})


@query("column_moments", f"SELECT l_returnflag, {q6('avg(l_quantity)')} AS m, {q6('var_samp(l_quantity)')} AS v, {q6('stddev_samp(l_quantity)')} AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return frames.moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", *[nulls.q6(F.col(c)).alias(c) for c in "mvs"])


@query("stacked_bar", "WITH a AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_linenumber, l_returnflag, CAST(sum(n) OVER (PARTITION BY l_linenumber ORDER BY l_returnflag) AS BIGINT) AS top FROM a")
def _(spark, d):
    return frames.stacked(table(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag").drop("n")


@query("ecdf", f"SELECT o_orderkey, {q6('cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice)')} AS f FROM orders")
def _(spark, d):
    r = ranks.with_rank(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "max")
    return r.select("o_orderkey", nulls.q6(F.col("rank") / F.col("group_size")).alias("f"))


@query("normalise_sum_one", f"WITH a AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) SELECT l_partkey, {q6('q * 1e0 / sum(q) OVER ()')} AS w FROM a")
def _(spark, d):
    return frames.to_sum_one(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q")), "q", "w").select("l_partkey", nulls.q6(F.col("w")).alias("w"))


@query("guide_qc", f"""WITH x AS (SELECT event_type, floor(value * 100 + 0.5e0) AS v, log2(floor(value * 100 + 0.5e0) + 1) AS lv FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, median(v) AS med FROM x GROUP BY 1),
 r AS (SELECT event_type, lv, row_number() OVER (PARTITION BY event_type ORDER BY lv) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM x), g AS (SELECT event_type, sum((2 * i - n - 1) * lv) / (max(n) * sum(lv)) AS gini FROM r GROUP BY 1)
 SELECT x.event_type, CAST(sum(v) AS BIGINT) AS total, {q6('100e0 * count(CASE WHEN v = 0 THEN 1 END) / count(*)')} AS pct_zero, {q6('max(med)')} AS med, {q6('1.4826e0 * median(abs(v - med))')} AS mad, max(v) AS top, {q6('max(gini)')} AS gini FROM x JOIN m ON m.event_type = x.event_type JOIN g ON g.event_type = x.event_type GROUP BY 1""")
def _(spark, d):
    x = table(spark, d, "events").where("value is not null").select("event_type", F.floor(F.col("value") * 100 + 0.5).alias("v"))
    got = evidence.guide_qc(x, "event_type", "v")
    return got.select("event_type", "total", *[nulls.q6(F.col(c)).alias(c) for c in ("pct_zero", "med", "mad")], "top", nulls.q6(F.col("gini")).alias("gini"))


@query("hist_bounds", "SELECT CAST(least(floor(l_quantity / 5), 9) AS BIGINT) AS bin, count(*) AS n, least(floor(l_quantity / 5), 9) * 5e0 AS lower_ FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 3")
def _(spark, d):
    return plotdata.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 5.0, 10).withColumnRenamed("lower", "lower_")


@query("hist_step", "WITH b AS (SELECT min(p_retailprice) AS lo FROM part) SELECT CAST(least(floor((p_retailprice - lo) / 50), 19) AS BIGINT) AS bin, count(*) AS n FROM part, b WHERE p_retailprice <= lo + 50 * 20 GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part")
    low = p.agg(F.min("p_retailprice")).first()[0]
    return plotdata.histogram(p, "p_retailprice", low, 50.0, 20).select("bin", "n")


@query("hist_relative_density", f"WITH h AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS total FROM h) SELECT bin, {q6('n * 1e0 / total')} AS rel, {q6('n * 1e0 / total / 5')} AS dens FROM h CROSS JOIN t")
def _(spark, d):
    return frames.relative(frames.step_histogram(table(spark, d, "lineitem"), "l_quantity", 5), 5).select("bin", *[nulls.q6(F.col(c)).alias(c) for c in ("rel", "dens")])


@query("hist_stacked", "WITH h AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, l_returnflag AS stratum, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT bin, stratum, n, CAST(sum(n) OVER (PARTITION BY bin ORDER BY stratum) AS BIGINT) AS top FROM h")
def _(spark, d):
    return frames.stacked(table(spark, d, "lineitem").select(frames.bin_of(F.col("l_quantity"), 5).alias("bin"), F.col("l_returnflag").alias("stratum")), ["bin"], "stratum")


@query("hist_ratio", f"WITH a AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT a.bin, {q6('a.n * 1e0 / b.n')} AS ratio FROM a JOIN b ON a.bin = b.bin")
def _(spark, d):
    return frames.ratio(*[frames.step_histogram(t, "l_quantity", 5) for t in (table(spark, d, "lineitem").where("l_returnflag = 'R'"), table(spark, d, "lineitem"))]).select("bin", nulls.q6(F.col("ratio")).alias("ratio"))


@query("hist_scatter", "WITH h AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin * 5 + 2.5e0 AS x, n AS y, 0e0 AS zero_, 5e0 AS width FROM h WHERE n > 0")
def _(spark, d):
    return frames.step_histogram(table(spark, d, "lineitem"), "l_quantity", 5).select((F.col("lower") + 2.5).alias("x"), F.col("n").alias("y"), F.lit(0.0).alias("zero_"), F.lit(5.0).alias("width"))


_P6 = lambda p: f"CASE WHEN c = 1 OR {p} * (c + 1) <= 1 THEN v[1] WHEN {p} * (c + 1) >= c THEN v[c] ELSE v[CAST(floor({p} * (c + 1)) AS INT)] + ({p} * (c + 1) - floor({p} * (c + 1))) * (v[CAST(floor({p} * (c + 1)) AS INT) + 1] - v[CAST(floor({p} * (c + 1)) AS INT)]) END"
_BOX = "WITH a AS (SELECT {} AS g, list_sort(list(p_retailprice)) AS v, count(p_retailprice) AS c FROM part GROUP BY 1) SELECT g, v[1] AS lo, " + ", ".join(f"{q6(_P6(p))} AS {n}" for p, n in (("0.25e0", "q1"), ("0.5e0", "median"), ("0.75e0", "q3"))) + ", v[c] AS hi FROM a"


def _box(spark, d, group):
    b = plotdata.box(table(spark, d, "part").withColumn("g", F.expr(group)), ["g"], "p_retailprice")
    return b.select("g", "lo", *[nulls.q6(F.col(c)).alias(c) for c in ("q1", "median", "q3")], "hi")


query("box_by_group", _BOX.format("p_brand"))(lambda spark, d: _box(spark, d, "p_brand"))
query("box_by_bin", _BOX.format("CAST(floor(p_size / 10) AS BIGINT)"))(lambda spark, d: _box(spark, d, "cast(floor(p_size / 10) as bigint)"))


@query("percentile_type6", _BOX.format("p_size").replace("SELECT g, v[1] AS lo, ", "SELECT g, ").replace(", v[c] AS hi FROM", " FROM"))
def _(spark, d):
    return _box(spark, d, "p_size").drop("lo", "hi")


@query("kde_1d", f"WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, 1.06e0 * stddev_samp(p_retailprice) * power(51e0, -0.2e0) AS h FROM part), g AS (SELECT i, lo + i * ((hi - lo) / 50) AS pt, h FROM b, range(51) t(i)) SELECT {q6('pt')} AS pt, {q6('1e3 * avg(exp(-0.5e0 * ((pt - p_retailprice) / h) * ((pt - p_retailprice) / h))) / (h * 2.5066282746310002e0)')} AS density FROM g, part GROUP BY i, pt, h")
def _(spark, d):
    return plotdata.kde(table(spark, d, "part"), "p_retailprice").select(nulls.q6(F.col("at")).alias("pt"), nulls.q6(1e3 * F.col("density")).alias("density"))


def _near_sql(o: str) -> str:
    cx, cy = f"((floor((p_size - {o} * 4) / 4 + 0.5e0) + {o}) * 4)", f"((floor((p_retailprice - {o} * 60) / 60 + 0.5e0) + {o}) * 60)"
    return f"{{'d': ((p_size - {cx}) / 4) * ((p_size - {cx}) / 4) + 3 * ((p_retailprice - {cy}) / 60) * ((p_retailprice - {cy}) / 60), 'cx': {cx}, 'cy': {cy}}}"


@query("hexbin", f"WITH a AS (SELECT least({_near_sql('0e0')}, {_near_sql('0.5e0')}) AS b FROM part) SELECT b.cx AS cx, b.cy AS cy, count(*) AS n FROM a GROUP BY 1, 2")
def _(spark, d):
    return plotdata.hexbin(table(spark, d, "part"), "p_size", "p_retailprice", 4.0, 60.0)


# windows, sorts, sets


@query("first_rank", f"WITH {SCORES} SELECT screen, gene, row_number() OVER (PARTITION BY screen ORDER BY score, gene) AS r FROM s")
def _(spark, d):
    s = ranks.numbered(evidence.screen_scores(table(spark, d, "lineitem")), ["screen"], ["score", "gene"])
    return s.select("screen", "gene", F.col("i").alias("r"))


@query("random_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS r FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("h", evalml.hash_order(F.col("o_orderkey")))
    return ranks.numbered(o, ["o_orderpriority"], ["h", "o_orderkey"]).select("o_orderkey", F.col("i").alias("r"))


@query("zscore", f"WITH m AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS s FROM customer) SELECT c_custkey, {q6('(c_acctbal - a) / s')} AS z FROM customer CROSS JOIN m")
def _(spark, d):
    return frames.zscore(table(spark, d, "customer"), "c_acctbal", "z").select("c_custkey", nulls.q6(F.col("z")).alias("z"))


@query("clamp_max_below_one", f"WITH {PV}, m AS (SELECT max(CASE WHEN p < 1 THEN p END) AS top FROM pv) SELECT screen, gene, {q6('CASE WHEN p = 1 THEN top ELSE p END')} AS p FROM pv CROSS JOIN m")
def _(spark, d):
    return tables.clamp_below(p_values(spark, d), "p", 1.0).select("screen", "gene", nulls.q6(F.col("p")).alias("p"))


@query("running_cdf", "WITH a AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT q, CAST(sum(n) OVER (ORDER BY q) AS BIGINT) AS upto FROM a")
def _(spark, d):
    return frames.cumulative_counts(table(spark, d, "lineitem").select(F.col("l_quantity").alias("q")), "q")


same("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


@query("frequency_filter", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 3")
def _(spark, d):
    return frames.frequent(table(spark, d, "lineitem"), ["l_partkey"], 3)


@query("head_tail", "SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20) a UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20) b")
def _(spark, d):
    return frames.head_tail(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 20)


@query("factor_sort", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS ord FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", frames.factor(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("ord"))


@query("edge_union", "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, 1e0 AS w FROM (SELECT c_nationkey AS a, c_custkey % 25 AS b FROM customer UNION ALL SELECT s_nationkey AS a, s_suppkey % 25 AS b FROM supplier) t WHERE a <> b")
def _(spark, d):
    return frames.union_pairs([table(spark, d, t).selectExpr(f"{k}_nationkey AS a", f"{i} % 25 AS b") for t, k, i in (("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"))])


same("gmt_explode", "SELECT DISTINCT doc_id, unnest(list_slice(string_split(text, chr(10)), 3, 1000000)) AS member FROM documents", "SELECT DISTINCT doc_id, explode(slice(split(text, '\\n'), 3, greatest(size(split(text, '\\n')) - 2, 0))) AS member FROM documents")


@query("table_query", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_full_match(c_mktsegment, 'build.*|auto.*', 'i') ORDER BY TRY_CAST(c_name AS DOUBLE) IS NULL DESC, c_name DESC, c_custkey LIMIT 100 OFFSET 100")
def _(spark, d):
    q = tables.TableQuery(["c_custkey", "c_mktsegment"], "build.*|auto.*", True, ["c_name", "c_mktsegment"], "c_name", True, 1)
    return q.run(table(spark, d, "customer"))


@query("mixed_type_sort_page", "WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS k FROM part) SELECT p_partkey, k FROM k ORDER BY TRY_CAST(k AS DOUBLE) IS NULL, coalesce(TRY_CAST(k AS DOUBLE), 0), k, p_partkey LIMIT 100")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("case when p_partkey % 2 = 0 then cast(p_size as string) else p_name end").alias("k"))
    return p.orderBy(*tables.mixed_order(F.col("k")), "p_partkey").limit(100)


@query("regex_projection", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    return tables.regex_projection(table(spark, d, "part"), [".*name", "p_s.*"], ["p_partkey"])


@query("pair_conflict_check", "SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, 1e0 AS w FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return graph.canonical_pairs(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit(1.0).alias("w")))


@query("stochastic_edges", f"WITH {NATIONS} SELECT src, dst, {q6('w')} AS w FROM m")
def _(spark, d):
    return graph.stochastic(*nations(spark, d)).select("src", "dst", nulls.q6(F.col("w")).alias("w"))


@query("stochastic_drop_isolated", f"WITH {NATIONS} SELECT b.src, b.dst, {q6('w / degree')} AS w FROM b JOIN deg ON b.src = deg.src")
def _(spark, d):
    return graph.stochastic(*nations(spark, d), drop_isolated=True).select("src", "dst", nulls.q6(F.col("w")).alias("w"))


@query("vertex_set", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey AS id FROM supplier")
def _(spark, d):
    return graph.vertices(table(spark, d, "customer").selectExpr("c_nationkey AS src", "c_nationkey AS dst").unionAll(table(spark, d, "supplier").selectExpr("s_nationkey", "s_nationkey")))


def _iterate(step: str, start: str, n: int, keys: str = "id") -> str:
    parts = [f"p0 AS MATERIALIZED ({start})"] + [f"p{i + 1} AS MATERIALIZED ({step.format(p=f'p{i}')})" for i in range(n)]
    return ", ".join(parts)


_WALK = _iterate("SELECT id, sum(p) AS p FROM (SELECT m.dst AS id, 0.5e0 * m.w * q.p AS p FROM m JOIN {p} q ON m.src = q.id UNION ALL SELECT id, 0.5e0 * p FROM p0) t GROUP BY 1", "{start}", 15)
_ONE = "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 1e0 ELSE 0e0 END AS p FROM nation"


@query("rwr_single", f"WITH {NATIONS}, {_WALK.replace('{start}', _ONE)} SELECT id, {q6('p')} AS p FROM p15")
def _(spark, d):
    e, n = nations(spark, d)
    p0 = n.select("id", F.when(F.col("id") == 3, 1.0).otherwise(0.0).alias("p"))
    return graph.walk(graph.stochastic(e, n), p0).select("id", nulls.q6(F.col("p")).alias("p"))


_DATA = "SELECT n_nationkey AS id, coalesce(v, 0e0) / (SELECT sum(n_regionkey + 1) FROM nation WHERE n_nationkey % 2 = 0) AS p FROM nation LEFT JOIN (SELECT n_nationkey AS k, (n_regionkey + 1) * 1e0 AS v FROM nation WHERE n_nationkey % 2 = 0) t ON k = n_nationkey"


@query("propagate", f"WITH {NATIONS}, {_WALK.replace('{start}', _DATA)} SELECT id, {q6('p')} AS p FROM p15")
def _(spark, d):
    e, n = nations(spark, d)
    data = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1).cast("double").alias("p"))
    return graph.propagate(graph.stochastic(e, n), n, data).select("id", nulls.q6(F.col("p")).alias("p"))


_CENTRAL = _iterate("SELECT m.dst AS id, sum(m.w * q.p) AS p FROM m JOIN {p} q ON m.src = q.id GROUP BY 1", "SELECT n_nationkey AS id, 1e0 / count(*) OVER () AS p FROM nation", 100)


@query("eigen_centrality", f"WITH {NATIONS}, {_CENTRAL} SELECT id, {q6('p / sum(p) OVER ()')} AS p FROM p100")
def _(spark, d):
    e, n = nations(spark, d)
    return graph.centrality(graph.stochastic(e, n), n).select("id", nulls.q6(F.col("p")).alias("p"))


@query("rwr_degree_normalised", f"WITH {NATIONS}, {_WALK.replace('{start}', _ONE)}, u AS (SELECT n_nationkey AS id, 1e0 / 25 AS q FROM nation) SELECT p15.id, {q6('CASE WHEN p = 0 THEN 0e0 ELSE p * (ln(p) - ln(q)) END')} AS kl, {q6('p / q')} AS lrt FROM p15 JOIN u ON u.id = p15.id")
def _(spark, d):
    e, n = nations(spark, d)
    p = materialize(graph.walk(graph.stochastic(e, n), n.select("id", F.when(F.col("id") == 3, 1.0).otherwise(0.0).alias("p"))))
    u = n.select("id", F.lit(1.0 / 25).alias("q"))
    kl, lrt = (graph.degree_normalise(p, u, how).select("id", nulls.q6(F.col("p")).alias(how)) for how in ("kl", "lrt"))
    return kl.join(lrt, "id")


_DIFF = _iterate("SELECT source, id, sum(p) AS p FROM (SELECT q.source, m.dst AS id, 0.5e0 * m.w * q.p AS p FROM m JOIN {p} q ON m.src = q.id UNION ALL SELECT source, id, 0.5e0 * p FROM p0) t GROUP BY 1, 2", "SELECT n_nationkey AS source, n_nationkey AS id, 1e0 AS p FROM nation", 15)


@query("diffusion_matrix", f"WITH {NATIONS}, {_DIFF} SELECT source, id, {q6('p')} AS p FROM p15")
def _(spark, d):
    e, n = nations(spark, d)
    return graph.diffusion(graph.stochastic(e, n), n).select("source", "id", nulls.q6(F.col("p")).alias("p"))


@query("sparse_mv", f"WITH {NATIONS} SELECT dst AS id, {q6('sum(w * (src + 1))')} AS p FROM m GROUP BY 1")
def _(spark, d):
    e, n = nations(spark, d)
    return graph.multiply(graph.stochastic(e, n), n.select("id", (F.col("id") + 1).cast("double").alias("p"))).select("id", nulls.q6(F.col("p")).alias("p"))


_CELLS = "x AS (SELECT l_linenumber AS i, l_returnflag AS j, count(*) AS v FROM lineitem GROUP BY 1, 2)"


@query("gram", f"WITH {_CELLS} SELECT a.j AS j1, b.j AS j2, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2")
def _(spark, d):
    return graph.gram(table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.count(F.lit(1)).alias("v")))


@query("matmul", f"WITH {_CELLS} SELECT a.i AS i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM x a JOIN x b ON a.j = b.j GROUP BY 1, 2")
def _(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.count(F.lit(1)).alias("v"))
    return graph.matmul(x, tables.transpose(x, "i", "j"))


@query("geneset_multigraph", """WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN 'gene' ELSE 'drug' END AS type, n_nationkey % 2 = 0 AND n_regionkey < 3 AS gene FROM nation),
 e AS (SELECT c_nationkey AS source, s_nationkey AS target, o_orderpriority AS relation, max(o_orderkey) AS attribute FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
 SELECT least(source, target) AS u, greatest(source, target) AS v, relation, max_by(attribute, attribute) AS attribute FROM e JOIN n s ON s.id = source JOIN n t ON t.id = target WHERE (s.gene AND t.gene) OR (s.gene AND t.type <> 'gene') OR (s.type <> 'gene' AND t.gene) GROUP BY 1, 2, 3""")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    n = t("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") < 3, "gene").otherwise("drug").alias("type"))
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.col("o_orderpriority").alias("relation")).agg(F.max("o_orderkey").alias("attribute"))
    return graph.gene_multigraph(n, e.withColumn("ordinal", F.col("attribute")), n.where("id % 2 = 0 and type = 'gene'").select("id"), "gene")


# evaluation
_TRUTH = "t AS (SELECT DISTINCT d.doc_id, n_chars AS score, quality = 1 AS truth FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_ROC = f"{_TRUTH}, b AS (SELECT score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM t GROUP BY 1), c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM b), k AS (SELECT score, tp, fp, tp * 1e0 / np AS tpr, fp * 1e0 / nn AS fpr FROM c)"


def _truth(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("truth")).distinct()


def _curve(spark, d):
    return evalml.roc_curve(_truth(spark, d), "score", "truth")


@query("roc_curve", f"WITH {_ROC} SELECT score AS threshold, tp, fp, {q6('tpr')} AS tpr, {q6('fpr')} AS fpr FROM k")
def _(spark, d):
    return _curve(spark, d).select("threshold", "tp", "fp", nulls.q6(F.col("tpr")).alias("tpr"), nulls.q6(F.col("fpr")).alias("fpr"))


_SEG = f"{_ROC}, g AS (SELECT coalesce(lag(fpr) OVER (ORDER BY fpr, tpr), 0) AS x0, coalesce(lag(tpr) OVER (ORDER BY fpr, tpr), 0) AS y0, fpr AS x1, tpr AS y1 FROM k)"


@query("auc", f"WITH {_SEG} SELECT {q6('sum((x1 - x0) * (y0 + y1) / 2)')} AS auc FROM g")
def _(spark, d):
    return evalml.auc(_curve(spark, d)).select(nulls.q6(F.col("auc")).alias("auc"))


_CUTX = "least(x1, 0.2e0)"
_PART = f"sum(CASE WHEN x0 < 0.2e0 THEN ({_CUTX} - x0) * (y0 + CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * ({_CUTX} - x0) / (x1 - x0) ELSE y1 END) / 2 END)"


@query("partial_auc", f"WITH {_SEG} SELECT {q6(f'0.5e0 * (1 + ({_PART} - 0.02e0) / (0.2e0 - 0.02e0))')} AS auc FROM g")
def _(spark, d):
    return evalml.auc(_curve(spark, d), 0.2).select(nulls.q6(F.col("auc")).alias("auc"))


@query("threshold", f"WITH {_ROC} SELECT {q6('max(tpr - fpr)')} AS youden, arg_max(score, {{'a': tpr - fpr, 'b': score}}) AS threshold FROM k")
def _(spark, d):
    return evalml.youden_threshold(_curve(spark, d)).select(nulls.q6(F.col("youden")).alias("youden"), "threshold")


@query("average_precision", f"WITH {_TRUTH}, r AS (SELECT truth, row_number() OVER (ORDER BY score DESC, doc_id) AS i, sum(CASE WHEN truth THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM t) SELECT {q6('avg(tp * 1e0 / i)')} AS ap FROM r WHERE truth")
def _(spark, d):
    return evalml.average_precision(_truth(spark, d), "score", "truth", "doc_id").select(nulls.q6(F.col("ap")).alias("ap"))


@query("stratified_folds", "WITH l AS (SELECT DISTINCT doc_id, quality FROM labels) SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) - 1) % 3 AS fold FROM l")
def _(spark, d):
    return evalml.stratified_folds(table(spark, d, "labels").select("doc_id", "quality").distinct(), "quality", "doc_id", 3)


_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query("knn_graph", f"WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings), r AS (SELECT query, vec_id AS neighbour, row_number() OVER (PARTITION BY query ORDER BY {_D2.format(a='v', b='embedding')}, vec_id) AS rank FROM q JOIN embeddings ON vec_id <> query) SELECT query, neighbour, rank FROM r WHERE rank <= 15")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return evalml.knn_blocks(e, e, "vec_id", "embedding", 15).select("query", "neighbour", "rank")


@query("kmeans_step", f"WITH c AS (SELECT vec_id AS k, embedding AS v FROM embeddings WHERE vec_id < 10), r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY {_D2.format(a='embedding', b='v')}, k) AS i FROM embeddings, c) SELECT vec_id, k AS centre FROM r WHERE i = 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    centres = [(r.vec_id, list(r.embedding)) for r in e.where("vec_id < 10").orderBy("vec_id").collect()]
    return evalml.kmeans_step(e, "vec_id", "embedding", centres).select("vec_id", "centre")


@query("qnorm", f"WITH {PV} SELECT screen, gene, {q6(stats.qnorm_sql('p'))} AS z FROM pv WHERE p < 1")
def _(spark, d):
    return p_values(spark, d).where("p < 1").select("screen", "gene", nulls.q6(stats.qnorm("p")).alias("z"))


@query("gsea_es", f"""WITH {SCORES}, g AS (SELECT gene, max(score) AS stat FROM s GROUP BY 1), k AS (SELECT gene, stat, p_brand AS brand, row_number() OVER (ORDER BY stat DESC, gene) AS pos, count(*) OVER () AS n FROM g JOIN part ON p_partkey = gene),
 h AS (SELECT brand, pos, n, sum(stat) OVER (PARTITION BY brand ORDER BY pos) * 1e0 / sum(stat) OVER (PARTITION BY brand) AS hit, (sum(stat) OVER (PARTITION BY brand ORDER BY pos) - stat) * 1e0 / sum(stat) OVER (PARTITION BY brand) AS hit0, row_number() OVER (PARTITION BY brand ORDER BY pos) AS i, count(*) OVER (PARTITION BY brand) AS m FROM k)
 SELECT brand, {q6('CASE WHEN max(hit - (pos - i) * 1e0 / (n - m)) >= -min(hit0 - (pos - i) * 1e0 / (n - m)) THEN max(hit - (pos - i) * 1e0 / (n - m)) ELSE min(hit0 - (pos - i) * 1e0 / (n - m)) END')} AS es FROM h GROUP BY 1""")
def _(spark, d):
    from pyspark.sql import Window

    g = evidence.screen_scores(table(spark, d, "lineitem")).groupBy("gene").agg(F.max("score").alias("stat"))
    r = ranks.with_rank(g.select(F.lit(0).alias("g"), "gene", F.struct(-F.col("stat"), F.col("gene")).alias("o"), "stat"), ["g"], "o")
    k = r.join(table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand")), "gene").select("brand", "stat", F.col("rank").alias("pos"), F.col("group_size").alias("n"))
    by = Window.partitionBy("brand")
    upto = F.sum("stat").over(by.orderBy("pos"))
    h = k.select("brand", "pos", "n", (upto / F.sum("stat").over(by)).alias("hit"), ((upto - F.col("stat")) / F.sum("stat").over(by)).alias("hit0"), F.row_number().over(by.orderBy("pos")).alias("i"), F.count(F.lit(1)).over(by).alias("m"))
    miss = (F.col("pos") - F.col("i")) / (F.col("n") - F.col("m"))
    top, low = F.max(F.col("hit") - miss), F.min(F.col("hit0") - miss)
    return h.groupBy("brand").agg(nulls.q6(F.when(top >= -low, top).otherwise(low)).alias("es"))


@query("complex_members", "SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS member FROM part")
def _(spark, d):
    return files.split_members(table(spark, d, "part").select("p_brand", F.regexp_replace("p_name", " ", ";").alias("names")), "p_brand", "names")


@query("axis_window", f"WITH b AS (SELECT least(min(p_size), min(p_retailprice)) AS lo, greatest(max(p_size), max(p_retailprice)) AS hi FROM part) SELECT {q6('lo - 0.05e0 * (hi - lo)')} AS lo, {q6('hi + 0.05e0 * (hi - lo)')} AS hi FROM b")
def _(spark, d):
    return axes.window(table(spark, d, "part"), ["p_size", "p_retailprice"]).select(nulls.q6(F.col("lo")).alias("lo"), nulls.q6(F.col("hi")).alias("hi"))


@query("volcano", f"""WITH r AS (SELECT concat('P', p_partkey) AS label, (p_size - 25) * 1e0 AS effect, (p_partkey % 100) / 100e0 AS p, (p_partkey % 10) / 100e0 AS fdr FROM part), h AS (SELECT *, CASE WHEN effect < -5 AND fdr < 5e-2 THEN 'down' WHEN effect > 5 AND fdr < 5e-2 THEN 'up' WHEN label LIKE '%77%' THEN 'ctrl' ELSE 'a' END AS hit FROM r),
 k AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY p, label) AS i FROM h) SELECT label, effect, {q6('-log10(CASE WHEN p = 0 THEN (SELECT min(p) FROM r WHERE p > 0) ELSE p END)')} AS y, hit, CASE WHEN hit IN ('up', 'down') AND i <= 5 THEN label ELSE '' END AS text FROM k""")
def _(spark, d):
    r = table(spark, d, "part").selectExpr("concat('P', p_partkey) as label", "(p_size - 25) * 1e0 as effect", "(p_partkey % 100) / 100e0 as p", "(p_partkey % 10) / 100e0 as fdr")
    return axes.volcano(r, "label", "effect", "p", "fdr", control="77", effect_cut=5.0).withColumn("y", nulls.q6(F.col("y")))


@query("centred_gram", f"WITH x AS (SELECT l_linenumber AS i, l_partkey AS j, CAST(sum(l_quantity) AS BIGINT) * 1e0 AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT j, avg(v) AS m FROM x GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT i) FROM x)), c AS (SELECT i, x.j, v - m AS v FROM x JOIN w ON x.j = w.j) SELECT a.i AS a, b.i AS b, {q6('sum(a.v * b.v)')} AS g FROM c a JOIN c b ON a.j = b.j GROUP BY 1, 2")
def _(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").cast("long").cast("double").alias("v"))
    return linear.centred_gram(x).select("a", "b", nulls.q6(F.col("g")).alias("g"))
