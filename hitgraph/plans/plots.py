"""Queries of the relations that plots draw."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import axes, evalml, plotdata, plotrows
from .registry import PV, p_values, q6, query, table

_T = "CASE WHEN p > 1 THEN 1e0 WHEN p < 0 THEN 0e0 WHEN p > 0.3e0 THEN (p - 0.3e0) * 0.5e0 / 0.7e0 + 0.5e0 ELSE (p - 0e0) * 0.5e0 / 0.3e0 END"
_CLIP = "CAST(floor(least(greatest({}, 0e0), 1e0) * 255) AS INT)"


@query("colour_scale", f"WITH {PV}, h AS (SELECT screen, gene, p, (1e0 - {_T}) * 4 AS h FROM pv) SELECT screen, gene, {_CLIP.format('abs(h - 3) - 1')} AS heat_r, {_CLIP.format('2 - abs(h - 2)')} AS heat_g, {_CLIP.format('2 - abs(h - 4)')} AS heat_b, CAST(255 - floor(p * 255) AS INT) AS gray, CAST(floor(CASE WHEN p > 0.5e0 THEN 255 ELSE 255 + least((0.5e0 - p) / 0.5e0, 1e0) * (0 - 255) END) AS INT) AS red FROM h")
def _(spark, d):
    pv = p_values(spark, d)
    h, g, r = plotrows.heat(F.col("p"), mid=0.3), plotrows.gray(F.col("p")), plotrows.red_blue(F.col("p"))
    return pv.select("screen", "gene", h["r"].alias("heat_r"), h["g"].alias("heat_g"), h["b"].alias("heat_b"), g["r"].alias("gray"), r["r"].alias("red"))


@query("axis_scale", f"SELECT p_partkey, {q6('(p_retailprice - 100) / 1900e0 * 10')} AS linear, {q6('(ln(p_retailprice) / ln(10e0) - 2e0) / 2e0 * 10')} AS log_ FROM part")
def _(spark, d):
    v = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", nulls.q6(axes.scaled(v, 100.0, 2000.0, 10.0)).alias("linear"), nulls.q6(axes.scaled(v, 100.0, 10000.0, 10.0, 10.0)).alias("log_"))


@query("polynomial", f"SELECT p_partkey, i AS sample, {q6('-5e0 + i * 10e0 / 50')} AS x, {q6('(p_size + (-5e0 + i * 10e0 / 50) * ((p_partkey % 7) + (-5e0 + i * 10e0 / 50) * 0.5e0))')} AS y FROM part, range(50) t(i)")
def _(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.expr("array(cast(p_size as double), cast(p_partkey % 7 as double), 0.5e0)").alias("c"))
    return plotrows.polynomial(c, "c", -5.0, 5.0).select("p_partkey", F.col("sample").cast("long").alias("sample"), nulls.q6(F.col("x")).alias("x"), nulls.q6(F.col("y")).alias("y"))


@query("bar_extent", "SELECT min(p_size - 0.5e0) AS lo, max(p_size + 0.5e0) AS hi FROM part")
def _(spark, d):
    return plotrows.bar_extent(table(spark, d, "part"), "p_size", 0.5)


@query("bar_ordinal", "SELECT p_name, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS ordinal FROM part")
def _(spark, d):
    return plotrows.places(table(spark, d, "part"), [], ["p_retailprice", "p_partkey"], True).select("p_name", "p_retailprice", "ordinal")


@query("line_segments", "WITH k AS (SELECT p_brand, lag(p_size) OVER w AS x0, lag(p_retailprice) OVER w AS y0, p_size AS x1, p_retailprice AS y1 FROM part WHERE p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 1000 AND 1600 WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) SELECT * FROM k WHERE x0 IS NOT NULL")
def _(spark, d):
    return plotrows.line_segments(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_size", "p_retailprice", (5, 40, 1000, 1600))


_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query("segment_endpoints", f"WITH q AS (SELECT vec_id AS u, embedding AS v0 FROM embeddings), r AS (SELECT u, vec_id AS v, row_number() OVER (PARTITION BY u ORDER BY {_D2.format(a='v0', b='embedding')}, vec_id) AS rank FROM q JOIN embeddings ON vec_id <> u) SELECT u, v, rank, a.embedding[1] AS x1, a.embedding[2] AS y1, b.embedding[1] AS x2, b.embedding[2] AS y2 FROM r JOIN embeddings a ON a.vec_id = u JOIN embeddings b ON b.vec_id = v WHERE rank <= 5")
def _(spark, d):
    e = table(spark, d, "embeddings")
    edges = evalml.knn_blocks(e, e, "vec_id", "embedding", 5).select(F.col("query").alias("u"), F.col("neighbour").alias("v"), "rank")
    return plotrows.segment_endpoints(edges, e.select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")), "vec_id", "x", "y")


_SHARE = "CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) * 1e0 / (max({c}) OVER () - min({c}) OVER ()) ELSE 0e0 END"


@query("radar_scale", f"SELECT p_partkey, 'p_size' AS axis, {q6(_SHARE.format(c='p_size'))} AS share FROM part UNION ALL SELECT p_partkey, 'p_retailprice' AS axis, {q6(_SHARE.format(c='p_retailprice'))} AS share FROM part")
def _(spark, d):
    return plotrows.radar(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]).withColumn("share", nulls.q6(F.col("share")))


@query("raster_long", "WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS y FROM part) SELECT 0::BIGINT AS x, y, p_size * 1e0 AS z FROM r UNION ALL SELECT 1::BIGINT AS x, y, p_retailprice AS z FROM r")
def _(spark, d):
    return plotrows.raster(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


_P6 = lambda p: f"CASE WHEN c = 1 OR {p} * (c + 1) <= 1 THEN v[1] WHEN {p} * (c + 1) >= c THEN v[c] ELSE v[CAST(floor({p} * (c + 1)) AS INT)] + ({p} * (c + 1) - floor({p} * (c + 1))) * (v[CAST(floor({p} * (c + 1)) AS INT) + 1] - v[CAST(floor({p} * (c + 1)) AS INT)]) END"


@query("jitter_strength", f"WITH a AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v, count(p_retailprice) AS c FROM part GROUP BY 1), b AS (SELECT p_brand, {_P6('0.25e0')} AS q1, {_P6('0.5e0')} AS m, {_P6('0.75e0')} AS q3 FROM a) SELECT p_partkey, {q6('CASE WHEN q3 > q1 THEN 0.4e0 * exp(-2e0 * abs(p_retailprice - m) / (q3 - q1)) END')} AS strength FROM part JOIN b ON b.p_brand = part.p_brand")
def _(spark, d):
    p = table(spark, d, "part")
    b = plotdata.box(p, ["p_brand"], "p_retailprice")
    return plotrows.jitter_strength(p, b, ["p_brand"], "p_retailprice", 0.4, -2.0).select("p_partkey", nulls.q6(F.col("strength")).alias("strength"))


@query("swarm_density", f"WITH s AS (SELECT l_linenumber AS g, count(*) AS n, CASE WHEN stddev_samp(l_quantity) > 0 THEN stddev_samp(l_quantity) / 3 ELSE 1e0 END AS h FROM lineitem GROUP BY 1), v AS (SELECT l_linenumber AS g, l_quantity AS x, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT a.g AS l_linenumber, a.x, {q6('CASE WHEN n >= 10 THEN sum(b.c * exp(-0.5e0 * ((a.x - b.x) / h) * ((a.x - b.x) / h))) / (n * h * 2.5066282746310002e0) ELSE 0e0 END')} AS density FROM v a JOIN v b ON a.g = b.g JOIN s ON s.g = a.g GROUP BY 1, 2, n, h")
def _(spark, d):
    return plotrows.swarm_density(table(spark, d, "lineitem"), ["l_linenumber"], "l_quantity").withColumn("density", nulls.q6(F.col("density")))


@query("kde_2d", f"WITH a AS (SELECT p_size / 25e0 AS x, p_retailprice / 500 AS y FROM part), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM a), g AS (SELECT i AS ix, j AS iy, x0 + i * ((x1 - x0) / 19) AS gx, y0 + j * ((y1 - y0) / 19) AS gy, n FROM b, range(20) s(i), range(20) t(j)) SELECT ix, iy, {q6('gx')} AS gx, {q6('gy')} AS gy, {q6('sum(exp(-0.5e0 * ((x - gx) * (x - gx) + (y - gy) * (y - gy)) / 0.1e0)) / (n * 0.01e0)')} AS density FROM g, a GROUP BY ix, iy, gx, gy, n")
def _(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") / 25.0).alias("x"), (F.col("p_retailprice") / 500).alias("y"))
    return axes.density2d(p, "x", "y", 0.1, 20).select("ix", "iy", *[nulls.q6(F.col(c)).alias(c) for c in ("gx", "gy", "density")])


_END = "CASE WHEN ({a}z < level) <> ({b}z < level) THEN {{'x': {a}x + (level - {a}z) / ({b}z - {a}z) * ({b}x - {a}x), 'y': {a}y + (level - {a}z) / ({b}z - {a}z) * ({b}y - {a}y)}} END"


_GRID = "a AS (SELECT p_size / 25e0 AS x, p_retailprice / 500 AS y FROM part), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM a), k AS (SELECT i AS ix, j AS iy, x0 + i * ((x1 - x0) / 19) AS gx, y0 + j * ((y1 - y0) / 19) AS gy, n FROM b, range(20) s(i), range(20) t(j)), g AS MATERIALIZED (SELECT ix, iy, gx AS x, gy AS y, sum(exp(-0.5e0 * ((a.x - gx) * (a.x - gx) + (a.y - gy) * (a.y - gy)) / 0.1e0)) / (n * 0.01e0) AS z FROM k, a GROUP BY ix, iy, gx, gy, n)"


@query("contour_segments", f"""WITH {_GRID},
 t AS (SELECT p.x AS px, p.y AS py, p.z AS pz, o.x AS ox, o.y AS oy, o.z AS oz, s.x AS sx, s.y AS sy, s.z AS sz FROM g p JOIN g s ON s.ix = p.ix + 1 AND s.iy = p.iy + 1 JOIN g o ON (o.ix = p.ix AND o.iy = p.iy + 1) OR (o.ix = p.ix + 1 AND o.iy = p.iy)),
 e AS (SELECT level, list_filter([{_END.format(a='p', b='o')}, {_END.format(a='o', b='s')}, {_END.format(a='p', b='s')}], lambda q: q IS NOT NULL) AS e FROM t, (SELECT unnest([20e0, 25e0, 30e0, 35e0]) AS level) l)
 SELECT level, {q6('e[1].x')} AS x0, {q6('e[1].y')} AS y0, {q6('e[2].x')} AS x1, {q6('e[2].y')} AS y1 FROM e WHERE len(e) = 2""")
def _(spark, d):
    """Level lines of the density of parts by size and price."""
    p = table(spark, d, "part").select((F.col("p_size") / 25.0).alias("x"), (F.col("p_retailprice") / 500).alias("y"))
    got = axes.contour(axes.density2d(p, "x", "y", 0.1, 20), [20.0, 25.0, 30.0, 35.0])
    return got.select("level", *[nulls.q6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])
