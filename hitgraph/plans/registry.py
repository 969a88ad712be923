"""The registry of queries, and the bindings of the study's shapes to the driver's tables that several modules share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Q6 = "floor(({}) * 1e6 + 0.5e0) / 1e6"


def q6(x: str) -> str:
    return Q6.format(x)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query whose SQL both engines read; spark_sql where Spark's spelling differs."""
    text = spark_sql or sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        body = re.sub(r"\b(" + "|".join(used) + r")\b(?!\s*\()", r"{\1}", text) if used else text
        return spark.sql(body, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLE[name] = sql


SCORES = "s AS (SELECT l_linenumber AS screen, l_partkey AS gene, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2)"
PV = SCORES + ", pv AS (SELECT screen, gene, score, power(rank() OVER (PARTITION BY screen ORDER BY score) * 1e0 / count(*) OVER (PARTITION BY screen), 3) AS p FROM s)"
#: Fisher's closed form in DuckDB.
COMB = PV + ", f AS (SELECT screen % 3 AS pathogen, gene, -sum(ln(p)) AS x, count(p) AS k FROM pv GROUP BY 1, 2), comb AS (SELECT pathogen, gene, k, exp(-x) * list_sum(list_transform(range(0, k), lambda i: x ** i / factorial(i::INT))) AS p FROM f)"
CUT = COMB + ", r AS (SELECT p, count(*) OVER (ORDER BY p) AS last, count(*) OVER () AS m FROM comb), c AS (SELECT coalesce(max(CASE WHEN p <= last * 5e-2 / m THEN p END), 0e0) AS cutoff FROM r)"


def p_values(spark, sf_dir):
    return evidence.rank_p(evidence.screen_scores(table(spark, sf_dir, "lineitem")))


# graph over nations: customer's nation x supplier's nation by order line, thinned so that it is not complete
NATIONS = """e AS (SELECT least(c_nationkey, s_nationkey) AS src, greatest(c_nationkey, s_nationkey) AS dst, count(*) * 1e0 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
 g AS (SELECT * FROM e WHERE (7 * src + 11 * dst) % 6 = 0 AND dst < 23), b AS (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g), deg AS (SELECT src, sum(w) AS degree FROM b GROUP BY 1),
 m AS (SELECT b.src, b.dst, w / degree AS w FROM b JOIN deg ON b.src = deg.src UNION ALL SELECT n_nationkey, n_nationkey, 1e0 FROM nation WHERE n_nationkey NOT IN (SELECT src FROM deg))"""


def nations(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("src"), F.greatest("c_nationkey", "s_nationkey").alias("dst")).agg((F.count(F.lit(1)) * 1.0).cast("double").alias("w"))
    return e.where("(7 * src + 11 * dst) % 6 = 0 and dst < 23"), t("nation").select(F.col("n_nationkey").alias("id"))
