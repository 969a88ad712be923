import datetime

import pytest
from pyspark.sql import functions as F

from hitgraph.operators import evalml, plotrows, ranks


def placed(df, group, order, descending=False, by="id"):
    return {r[by]: r.ordinal for r in plotrows.places(df, group, order, descending).collect()}


def test_names_that_the_code_uses(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, i % 2, "x") for i in range(30)], "k long, n long, f0 int, _x string")
    got = evalml.stratified_folds(df, "n", "k", 5)
    assert sorted(r["count"] for r in got.groupBy("n", "fold").count().collect()) == [2] * 15
    assert evalml.leave_k_out(df, "k", 4).groupBy("fold").count().count() == 8
    assert sorted(placed(df, ["n"], ["f0", "k"], by="k").values()) == sorted([*range(10)] * 3)


def test_types_keep_their_order(spark):
    big = [2**53 + d for d in (3, 1, 2, 0)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "id long, v long")
    up = placed(df, [], ["v", "id"])
    assert [i for i, _ in sorted(up.items(), key=lambda x: x[1])] == [4, 3, 1, 2, 0, 5]
    down = placed(df, [], ["v", "id"], True)
    assert [i for i, _ in sorted(down.items(), key=lambda x: x[1])] == [5, 0, 2, 1, 3, 4]
    words = ["b", "a", "ab", "", "é", "a", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(words)], "id long, v string")
    want = sorted((i for i in range(6)), key=lambda i: (words[i].encode(), i))
    assert [i for i, _ in sorted(placed(df, [], ["v", "id"]).items(), key=lambda x: x[1])] == [*want, 6]
    want = sorted((i for i in range(6)), key=lambda i: ([255 - b for b in words[i].encode()] + [256], i))
    assert [i for i, _ in sorted(placed(df, [], ["v", "id"], True).items(), key=lambda x: x[1])] == [*want, 6]
    days = spark.createDataFrame([(i, datetime.date(2020, 1, d)) for i, d in enumerate((3, 1, 2))], "id long, v date")
    assert placed(days, [], ["v", "id"], True) == {0: 0, 2: 1, 1: 2}
    assert placed(days.withColumn("v", F.col("v").cast("timestamp")), [], ["v", "id"], True) == {0: 0, 2: 1, 1: 2}


def test_null_groups_and_values_stay(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), (None, 4.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted(((r.g, r.v, r["rank"], r.group_size) for r in ranks.with_rank(df, ["g"], "v").collect()), key=str)
    assert got == sorted([("a", 1.0, 1, 2), ("a", 2.0, 2, 2), ("a", None, None, None), (None, 5.0, 2, 2), (None, 4.0, 1, 2), (None, None, None, None)], key=str)
    run = ranks.running(spark.createDataFrame([(None, i, 1) for i in range(5)] + [("a", i, 1) for i in range(3)], "g string, o long, x long"), ["g"], "o", {"s": ("sum", "x")})
    assert sorted((r.s for r in run.where("g is null").collect())) == [1, 2, 3, 4, 5]


def test_unknown_types_are_refused(spark):
    df = spark.createDataFrame([(1, [1])], "id long, v array<int>")
    with pytest.raises(ValueError, match="descending"):
        plotrows.places(df, [], ["v", "id"], True)
