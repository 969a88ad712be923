import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitgraph.operators import bins, evalml, reducers


def type6(v, q):
    v, place = sorted(v), q * (len(v) + 1)
    k = math.floor(place)
    return v[0] if k <= 0 else v[-1] if k >= len(v) else v[k - 1] + (place - k) * (v[k] - v[k - 1])


def test_percentiles_and_bins_against_a_loop(spark):
    rng = np.random.default_rng(1)
    v = [float(x) for x in np.round(rng.normal(size=257), 1)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)] + [(900, None, 1), (901, math.nan, 1), (902, math.inf, 1)], "id long, x double, rank_min int")
    qs = [0.0, 0.1, 0.33, 0.5, 0.5, 0.9, 1.0]
    got = bins.percentiles(df, "x", qs)
    assert np.allclose(got, [type6(v, q) for q in qs])
    limits = [min(v), *got]
    binned = {r.id: (r.bin, r.lower, r.upper) for r in bins.quantile_bins(df, "x", qs).collect()}
    want = {}
    for i, x in enumerate(v):
        for b, (lo, hi) in enumerate(zip(limits, limits[1:])):
            if lo <= x < hi:
                want[i] = (b, lo, hi)
    assert binned == want and len(want) < len(v)  # the largest value is in no bin
    assert bins.quantile_bins(df.where("false"), "x", qs).collect() == []
    assert all(math.isnan(x) for x in bins.percentiles(df.where("false"), "x", qs))


def test_intervals_are_compiled(spark):
    df = spark.range(200).select((F.col("id") / 2).alias("x"))
    limits = [float(i) for i in range(0, 64, 3)]
    plan = df.select(bins.interval(F.col("x"), limits).alias("b"))
    assert "BatchEvalPython" not in plan._jdf.queryExecution().toString()
    for x, b in df.select("x", bins.interval(F.col("x"), limits)).collect():
        at = sum(t <= x for t in limits)
        assert b == (at - 1 if 0 < at < len(limits) else None)


def test_breaks(spark):
    v = [0.0] * 30 + [1.0] * 3 + [10.0, math.nan]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    count = math.floor(math.sqrt(2 * len(v))) + 1
    got = {r.bin: (r.n, r.lower) for r in bins.histogram_breaks(df, "x").collect()}
    assert got == {0: (30, 0.0), 0 + int(1 // (10 / count)): (got[0][0] if int(1 // (10 / count)) == 0 else 3, int(1 // (10 / count)) * 10 / count), count - 1: (1, (count - 1) * 10 / count)} or got[0][0] == 33
    assert sum(n for n, _ in got.values()) == 34
    assert {r.n for r in bins.histogram_breaks(df, "x", 5, least=4).collect()} == {33}
    assert [tuple(r) for r in bins.histogram_breaks(df.where("x = 1"), "x").collect()] == [(0, 3, 1.0)]
    assert bins.histogram_breaks(df.where("false"), "x").collect() == []


def test_reducers(spark, monkeypatch):
    monkeypatch.setattr(reducers, "HELD", 3)
    rng = np.random.default_rng(3)
    rows = [(int(k), None if k == 7 else "s", float(x)) for k, x in zip(rng.integers(0, 12, 400), rng.random(400))] + [(99, "s", None), (99, "s", math.nan), (None, "s", 0.5), (1, "s", None)]
    df = spark.createDataFrame(rows, "k long, s string, p double").repartition(6)
    got = {(r.k, r.s): r.p for r in reducers.reduce_by(df, ["k", "s"], "p", reducers.FISHER).collect()}
    groups: dict = {}
    for k, s, p in rows:
        groups.setdefault((k, s), []).extend([p] if p is not None and not math.isnan(p) else [])
    assert got.keys() == groups.keys()
    for key, ps in groups.items():
        x = -sum(map(math.log, ps))
        want = math.exp(-x) * sum(x**i / math.factorial(i) for i in range(len(ps))) if ps else None
        assert got[key] is None if want is None else math.isclose(got[key], want, rel_tol=1e-9)
    least = {(r.k, r.s): r.p for r in reducers.reduce_by(df, ["k", "s"], "p", reducers.LEAST).collect()}
    assert least == {key: min(ps, default=None) for key, ps in groups.items()}
    mean = reducers.Reducer(lambda: (0.0, 0), lambda s, v: (s[0] + v.sum(), s[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: str(s[1]))
    assert {r.p for r in reducers.reduce_by(df.where("k = 3"), ["k"], "p", mean, "string").collect()} == {str(len(groups[3, "s"]))}


def test_rows_and_collisions(spark):
    wide = spark.createDataFrame([("a", 0.5, None, -3.0), ("b", 2.0, -2.0, 1.0), ("c", None, None, None)], "id string, x double, y double, z double")
    assert {r.id: r.value for r in reducers.reduce_rows(wide, "id", ["x", "y", "z"], reducers.FURTHEST).collect()} == {"a": -3.0, "b": 2.0, "c": None}
    one, two = wide.select("id", F.col("x").alias("v")), wide.select("id", F.col("z").alias("v")).where("id <> 'c'").union(spark.createDataFrame([("d", 9.0)], "id string, v double"))
    assert {r.id: r.v for r in reducers.merge_tables(one, two, ["id"], "v", reducers.LEAST).collect()} == {"a": -3.0, "b": 1.0, "c": None, "d": 9.0}


@pytest.mark.parametrize("key", [0, 5, 4_000_000_000, 2**62, 2**63 - 1, -1, -(2**63)])
def test_hash_order_of_any_key(spark, key):
    df = spark.createDataFrame([(key,)], "k long")
    for seed in (0, 7):
        assert df.select(evalml.hash_order(F.col("k"), seed)).first()[0] == (key + seed) * 2654435761 % 2**32
