"""Frames by key: NULL keys and values, ties, empty tables, repeats."""

import math

import pytest

from pyspark.sql import functions as F

from hitgraph.operators import frames


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([("a", 1, 2.0), ("b", 1, 0.0), ("a", 2, float("nan")), (None, 2, 4.0), ("c", None, None)], "k string, g int, x double")


def test_joins_by_key(spark, t):
    index = spark.createDataFrame([("a", 7), (None, 8), ("z", 9)], "k string, y int")
    assert rows(frames.reindex(t.select("k"), "k", index, fill=0)) == [("a", 7), ("a", 7), ("b", 0), ("c", 0), (None, 0)]
    assert rows(frames.members(t, "k", index).select("k", "g")) == [("a", 1), ("a", 2)]  # index rows repeat nothing
    assert rows(frames.members(t, "k", index.unionAll(index)).select("k", "g")) == [("a", 1), ("a", 2)]
    assert rows(frames.without(t, "k", index).select("k")) == [("b",), ("c",), (None,)]
    assert rows(frames.without(t, "k", t.where("g = 1")).select("k")) == [("c",), (None,)]  # of one table
    assert rows(frames.flagged(t.select("k"), "k", index, "k", 1, 0)) == [("a", 1), ("a", 1), ("b", 0), ("c", 0), (None, 0)]
    assert rows(frames.in_all_groups(t, "k", "g")) == [("a",)] and frames.in_all_groups(t.limit(0), "k", "g").count() == 0


def test_columns_beside(spark):
    a, b, c = (spark.createDataFrame(r, f"k string, {n} int") for n, r in (("x", [("p", 1), ("q", 2), (None, 3)]), ("y", [("q", 4), (None, 5)]), ("z", [("q", 6), ("r", 7)])))
    assert rows(frames.columns_beside([a, b, c], "k")) == [("q", 2, 4, 6)]
    assert rows(frames.columns_beside([a, b], "k")) == [("q", 2, 4), (None, 3, 5)]
    whole = frames.columns_beside([a, b, c], "k", "outer")
    assert rows(whole) == sorted([("p", 1, None, None), ("q", 2, 4, 6), ("r", None, None, 7), (None, 3, 5, None)], key=str)
    assert rows(frames.drop_na(whole)) == [("q", 2, 4, 6)]


def test_reshape_and_labels(spark, t):
    assert rows(frames.melt(t.where("g = 1"), ["k"], {"G": "g", "X": "x"})) == [("a", "G", 1.0), ("a", "X", 2.0), ("b", "G", 1.0), ("b", "X", 0.0)]
    assert rows(frames.pivot(t, "g", "k", "x", {"a": "A", "b": "B"}, F.max, -1.0).where("g = 1")) == [(1, 2.0, 0.0)]
    assert rows(frames.encode(t, "k").select("k", "code")) == sorted([("a", 0), ("a", 0), ("b", 1), ("c", 2), (None, None)], key=str)
    many = spark.range(5000).select(F.format_string("w%05d", (F.col("id") * 7919) % 5000).alias("k"))
    assert frames.encode(many, "k").where("code <> cast(substr(k, 2) AS int)").count() == 0
    assert frames.encode(t.limit(0), "k").count() == 0
    assert rows(frames.provenance(t, ["g"], "k")) == [(1, "a, b"), (2, "a"), (None, "c")]
    assert rows(t.select("k", frames.factor(F.col("k"), ["b", "a"]).alias("o")).distinct()) == [("a", 1), ("b", 0), ("c", 2), (None, 2)]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 1)], "a int, b int")
    assert rows(frames.union_pairs([pairs, pairs])) == [(1, 2, 1.0)]


def test_scales_and_counts(spark, t):
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    z = {r.x: r.z for r in frames.zscore(x, "x", "z").collect()}
    assert z == {1.0: -1.0, 2.0: 0.0, 3.0: 1.0, None: None}
    assert {r.z for r in frames.zscore(x.where("x = 2"), "x", "z").collect()} == {None}
    assert {r.x: r.w for r in frames.to_sum_one(x, "x", "w").collect()} == {1.0: 1 / 6, 2.0: 2 / 6, 3.0: 0.5, None: None}
    assert {r.w for r in frames.to_sum_one(spark.createDataFrame([(1.0,), (-1.0,)], "x double"), "x", "w").collect()} == {None}
    p = spark.createDataFrame([(0.0,), (0.01,), (1.0,), (None,)], "p double")
    assert {r.p: r.y for r in frames.neg_log10(p, "p", "y").collect()} == {0.0: 2.0, 0.01: 2.0, 1.0: 0.0, None: None}
    assert rows(frames.cumulative_counts(x.unionAll(x.where("x > 1")), "x")) == [(1.0, 1), (2.0, 3), (3.0, 5)]
    assert rows(frames.frequent(t, ["k"], 1)) == [("a", 2)]
    assert rows(frames.head_tail(x.dropna(), ["x"], 1)) == [(1.0,), (3.0,)] and frames.head_tail(x.limit(0), ["x"], 2).count() == 0
    assert rows(t.where(frames.inside({"x": (0, 3), "g": (None, 1)})).select("k")) == [("a",), ("b",)]


def test_histograms(spark):
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.9, 5.0, 5.0, math.inf, math.nan, None)], "x double")
    h = frames.step_histogram(v, "x", 5)
    assert rows(h) == [(-1, 1, -5.0), (0, 2, 0.0), (1, 2, 5.0)]
    assert rows(frames.relative(h, 5).select("bin", "rel", "dens")) == [(-1, 0.2, 0.04), (0, 0.4, 0.08), (1, 0.4, 0.08)]
    assert rows(frames.ratio(frames.step_histogram(v.where("x = 0"), "x", 5), h)) == [(0, 0.5)]
    s = spark.createDataFrame([(0, "a"), (0, "b"), (0, "b"), (1, "b")], "bin int, s string")
    assert rows(frames.stacked(s, ["bin"], "s")) == [(0, "a", 1, 1), (0, "b", 2, 3), (1, "b", 1, 1)]
