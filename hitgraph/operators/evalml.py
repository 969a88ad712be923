"""Evaluation: folds, ROC, AUC, average precision; nearest neighbours and one k-means step."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls
from . import pairs, plotrows, ranks
from .written import materialize

#: Rows of a part that a learner reads, about.
PART = 1 << 14


def hash_order(key: Column, seed: int = 0) -> Column:
    """A reproducible shuffle key that any SQL engine computes: (key + seed) * 2654435761 modulo 2^32, for keys of any size."""
    k = F.pmod(F.pmod(key.cast("long"), F.lit(4294967296)) + seed, F.lit(4294967296))
    high, low = F.shiftright(k, 16), k.bitwiseAND(F.lit(65535))  # by halves, as the product leaves 64 bits
    return F.pmod(F.pmod(high * F.lit(2654435761), F.lit(65536)) * 65536 + low * F.lit(2654435761), F.lit(4294967296))


def stratified_folds(df: DataFrame, stratum: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: each stratum is shuffled and dealt round-robin; key is unique."""
    dealt = plotrows.places(df.withColumn("_h", hash_order(F.col(key), seed)), [stratum], ["_h", key])
    return dealt.withColumn("fold", F.pmod(F.col("ordinal"), F.lit(k)).cast("long")).drop("_h", "ordinal")


def roc_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr and the point before: one point for each score, ties together; raises if a class is empty."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.lit(0).alias("_g"), F.col(score).alias("threshold")).agg(F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg"))
    by = ranks.running(by, ["_g"], "threshold", {"tp": ("sum", "_pos"), "fp": ("sum", "_neg")}, descending=True)
    out = by.crossJoin(F.broadcast(df.where(F.col(score).isNotNull()).agg(F.count_if(F.col(truth)).alias("_p"), F.count_if(~F.col(truth)).alias("_n"))))  # one row
    ok = F.assert_true((F.col("_p") > 0) & (F.col("_n") > 0), "one class is empty")
    share = lambda x, n: (x / F.col(n)).cast("double")
    return out.where(ok.isNull()).select(
        "threshold", "tp", "fp", share(F.col("tp"), "_p").alias("tpr"), share(F.col("fp"), "_n").alias("fpr"), share(F.col("tp") - F.col("_pos"), "_p").alias("tpr0"), share(F.col("fp") - F.col("_neg"), "_n").alias("fpr0")
    )


def auc(curve: DataFrame, max_fpr: float = 1.0, standardise: bool = True) -> DataFrame:
    """One row: trapezoid area up to max_fpr, the last step interpolated; below 1 optionally standardised.  curve: of roc_curve."""
    seg = curve.select(F.col("fpr0").alias("x0"), F.col("tpr0").alias("y0"), F.col("fpr").alias("x1"), F.col("tpr").alias("y1"))
    x = F.least("x1", F.lit(max_fpr))
    y = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * F.try_divide(x - F.col("x0"), F.col("x1") - F.col("x0"))).otherwise(F.col("y1"))
    area = F.coalesce(F.sum(F.when(F.col("x0") < max_fpr, (x - F.col("x0")) * (F.col("y0") + y) / 2)), F.lit(0.0))
    if max_fpr < 1 and standardise:
        low = max_fpr * max_fpr / 2
        area = 0.5 * (1 + (area - low) / (max_fpr - low))
    return seg.agg(area.alias("auc"))


def youden_threshold(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max(F.col("tpr") - F.col("fpr")).alias("youden"), F.max_by("threshold", F.struct(F.col("tpr") - F.col("fpr"), F.col("threshold"))).alias("threshold"))


def average_precision(df: DataFrame, score: str, truth: str, tie: str) -> DataFrame:
    """One row; ties are in order of `tie`, which is unique."""
    one = df.where(F.col(score).isNotNull()).select(F.lit(0).alias("_g"), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")).alias("_o"), F.lit(1).alias("_one"), F.col(truth).cast("int").alias("_true"))
    r = ranks.running(one, ["_g"], "_o", {"i": ("sum", "_one"), "tp": ("sum", "_true")})
    return r.where("_true = 1").agg(F.avg(F.col("tp") / F.col("i")).alias("ap"))


def two_class_metrics(df: DataFrame, score: str, truth: str, tie: str) -> DataFrame:
    """One row: auc1, ap1, threshold1 (of the largest tpr - fpr), n_true, n_false."""
    curve = materialize(roc_curve(df, score, truth))
    counts = df.where(F.col(score).isNotNull()).agg(F.count_if(F.col(truth)).alias("n_true"), F.count_if(~F.col(truth)).alias("n_false"))
    parts = [auc(curve).select(F.col("auc").alias("auc1")), average_precision(df, score, truth, tie).select(F.col("ap").alias("ap1")), youden_threshold(curve).select(F.col("threshold").alias("threshold1")), counts]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def evaluate(df: DataFrame, fold: str, folds: int, metric) -> DataFrame:
    """fold and the columns of metric(rows of the fold), a row a fold; folds are few and given."""
    out = None
    for k in range(folds):
        got = metric(df.where(F.col(fold) == k)).select(F.lit(k).cast("long").alias(fold), "*")
        out = got if out is None else out.unionByName(got)
    return out


def split_once(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Adds train: true for that share of the rows by a hash of an integer key; no shuffle."""
    return df.withColumn("train", hash_order(F.col(key), seed) < ratio * 4294967296)


def split_by_group(df: DataFrame, group: str, ratio: float, seed: int = 0) -> DataFrame:
    """split_once by an integer group: its rows stay together."""
    return split_once(df, group, ratio, seed)


def leave_k_out(df: DataFrame, key: str, k: int = 1, seed: int = 0) -> DataFrame:
    """Adds fold: k rows in each (the last may have fewer), in shuffled order; k = 1 leaves one out."""
    at = plotrows.places(df.withColumn("_h", hash_order(F.col(key), seed)), [], ["_h", key])
    return at.withColumn("fold", F.floor(F.col("ordinal") / k).cast("long")).drop("_h", "ordinal")


def premade_folds(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Rows with the fold that a table gives their key; others drop."""
    return df.join(folds.select(key, F.col("fold").cast("long").alias("fold")), key)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def knn(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, most: int = pairs.QUERIES) -> DataFrame:
    """(query, neighbour, d2, rank): the k nearest points of each query, by squared distance then key; blocks of some `most` queries."""
    return pairs.nearest(queries, points, key, vector, k, query_rows=most)


def knn_blocks(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, most: int = pairs.QUERIES) -> DataFrame:
    """knn, which takes any number of queries."""
    return knn(queries, points, key, vector, k, most)


def against_all(queries: DataFrame, points: DataFrame, key: str, vector: str, most: int = 100_000) -> DataFrame:
    """(query, query_vector, key, vector): each query with every point of another key; queries are a stated set.

    Queries are broadcast where they are `most` at most, else block by block of some most / 2, by hash.
    """
    n = queries.count()
    blocks = 1 if n <= most else -(-2 * n // most)
    out = None
    for b in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        side = F.broadcast(some.select(F.col(key).alias("query"), F.col(vector).alias("query_vector")))  # counted above
        got = points.select(key, vector).join(side, F.col(key) != F.col("query"))
        out = got if out is None else out.unionByName(got)
    return out


def kmeans_step(points: DataFrame, key: str, vector: str, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """Assign each point to its nearest centre (ties: lower number); centres are a bounded literal."""
    options = F.array(*[F.struct(squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("d2"), F.lit(i).cast("long").alias("centre")) for i, c in centres])
    best = F.array_min(options)
    return points.select(key, best["centre"].alias("centre"), best["d2"].alias("d2"))


def kmeans(points: DataFrame, key: str, vector: str, centres: list[tuple[int, list[float]]], most: int = 50) -> tuple[DataFrame, list[float]]:
    """Assignments (key, centre, d2) and the cost of each step, from given centres until the cost stays; an empty one stays put."""
    costs: list[float] = []
    while True:
        at = kmeans_step(points, key, vector, centres)
        costs.append(at.agg(F.sum("d2")).first()[0] or 0.0)
        if len(costs) > most or len(costs) > 1 and costs[-1] >= costs[-2]:
            return at, costs
        each = points.join(at, key).select("centre", F.posexplode(F.col(vector)).alias("p", "x")).groupBy("centre", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
        moved = {r["centre"]: [e["x"] for e in r["v"]] for r in each.groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v")).collect()}
        centres = [(i, moved.get(i, c)) for i, c in centres]


def in_fixed_order(df: DataFrame, key: str, rows: int = PART) -> DataFrame:
    """df dealt by a hash of the key and sorted: learners that draw rows by part and place then draw the same ones each time.

    A part holds some `rows` rows whatever the cluster: a forest's task adds up its part in one table of all nodes and sends
    it whole, so parts are as many as the rows need and not as the session shuffles.  df is written, as it is counted first.
    """
    return df.repartition(max(1, -(-df.count() // rows)), key).sortWithinPartitions(key)


def at_once(spark: SparkSession, fits: list[Callable[[], Any]]) -> list[Any]:
    """What each of a few functions gives, in threads: a fit waits for the driver at each level, and the others' tasks run meanwhile."""
    with ThreadPool(max(1, len(fits))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in fits], 1)


def forest_cv(df: DataFrame, key: str, vector: str, target: str, folds: int = 3, trees: int = 500, seed: int = 0) -> DataFrame:
    """key, p: the geometric mean over folds of the forest's probability of class 1; each fold's forest scores every row.

    target: 0 or 1.  Folds are stratified and repeatable; a forest tries sqrt(features + 1) features a split.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = stratified_folds(df, target, key, folds, seed).select(key, "fold", F.col(target).cast("double").alias("label"), array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))
    rows = materialize(rows)
    width = len(rows.first()["features"])
    model = RandomForestClassifier(numTrees=trees, featureSubsetStrategy=str(max(1, int((width + 1) ** 0.5))), seed=seed, probabilityCol="chance")
    dealt = in_fixed_order(rows, key).persist()
    try:
        models = at_once(df.sparkSession, [lambda k=k: model.fit(dealt.where(F.col("fold") != k)) for k in range(folds)])
    finally:
        dealt.unpersist()
    scored = None
    for fitted in models:
        got = fitted.transform(rows).select(key, nulls.safe_ln(vector_to_array("chance")[1]).alias("l"))
        scored = got if scored is None else scored.unionByName(got)
    return scored.groupBy(key).agg(F.exp(F.avg("l")).alias("p"))
