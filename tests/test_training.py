import math
import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hitgraph.operators import evalml, splits, training


def test_fitted_on_training_rows_alone(spark, tmp_path):
    """A place that is constant in training goes, however it varies in the rows held out; a saved model replays it."""
    rows = [(i, [float(i % 5), 7.0 if i < 60 else float(i), float(i % 3), float(i % 2)], float(i % 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double")
    model = training.forest("features", "label", 4, trees=5).fit(df.where("id < 60"))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    for m in (model, again):
        assert m.stages[0].getOrDefault("places") == [0, 2, 3]
        out = m.transform(df).orderBy("id").collect()
        assert out[80]["_kept"] == [0.0, 2.0, 0.0]
        assert all((r["_class"] == r.label) for r in out)
    # fitted on all rows the place stays: the leak that the loop must not have
    assert training.forest("features", "label", 4, trees=5).fit(df).stages[0].getOrDefault("places") == [0, 1, 2, 3]


def test_standardise_replays_training_moments(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [100.0, 6.0])], "id long, features array<double>")
    model = training.Standardise().fit(df.where("id < 3"))
    model.write().overwrite().save(str(tmp_path / "s"))
    for m in (model, training.StandardiseModel.load(str(tmp_path / "s"))):
        got = {r.id: r.scaled for r in m.transform(df).collect()}
        assert got[1] == pytest.approx([-1 / math.sqrt(2), 0.0]) and got[3] == pytest.approx([98 / math.sqrt(2), 0.0])
    assert training.DropConstant().fit(df.where("id = 1")).getOrDefault("places") == []  # one row has no deviation


def test_supervised_eval(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 150)
    x = np.column_stack([label + 0.3 * rng.normal(size=150), rng.normal(size=150), np.ones(150)])
    features = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(500, [None, 1.0, 1.0], 1), (501, None, 1), (502, [float("nan"), 1.0, 1.0], 1), (503, [1.0, 0.0, 1.0], 1)], "id long, v array<double>, fold int")
    targets = spark.createDataFrame([(i, int(k)) for i, k in enumerate(label)] + [(500, 1), (999, 0)], "id long, t int")
    one = training.supervised_eval(features, targets, "id", "v", "t", trees=30, seed=4)
    scores = {r.id: r.p for r in one.scores.collect()}
    assert scores.keys() == {*range(150), 503}  # rows without target are scored, rows without features are not
    right = np.mean([(scores[i] > 0.5) == bool(label[i]) for i in range(150)])
    assert right > 0.9
    metrics = one.metrics.orderBy("fold").collect()
    assert [r.fold for r in metrics] == [0, 1, 2]
    assert all(r.auc1 > 0.9 and r.ap1 > 0.85 and 48 <= r.n_true + r.n_false <= 52 for r in metrics)
    assert sum(r.n_true + r.n_false for r in metrics) == 150
    assert sum(r.n_true for r in metrics) == int(label.sum())
    # the geometric mean of what the three models say
    p = [{r.id: r["_chance"][1] for r in m.transform(features.where("id < 20").select("id", F.col("v").alias("_features"))).collect()} for m in one.models]
    for i in range(20):
        assert scores[i] == pytest.approx(float(np.prod([q[i] for q in p]) ** (1 / 3)), abs=1e-12)
    two = training.supervised_eval(features, targets, "id", "v", "t", trees=30, seed=4)
    assert {r.id: r.p for r in two.scores.collect()} == scores
    with pytest.raises(ValueError, match="features"):
        training.supervised_eval(features.where("false"), targets, "id", "v", "t")


def test_folds_are_fitted_side_by_side(spark):
    """All fits are under way at once; parts follow the rows, so that no draw depends on how the session shuffles."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 2))) for i in range(120)], "id long, v array<double>, t int")
    meeting, parts = threading.Barrier(3), []

    class Meets:
        def __init__(self, learner):
            self.learner = learner

        def fit(self, rows):
            meeting.wait(20)
            parts.append(rows.rdd.getNumPartitions())
            return self.learner.fit(rows)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    scores, plain = [], []
    try:
        for n in (3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = training.supervised_eval(df.select("id", "v"), df.select("id", "t"), "id", "v", "t", pipeline=lambda v, t, width: Meets(training.forest(v, t, width, trees=10)))
            scores.append({r.id: r.p for r in got.scores.collect()})
            plain.append({r.id: r.p for r in evalml.forest_cv(df, "id", "v", "t", trees=10).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts == [1] * 6
    assert len(scores[0]) == 120 and scores[0] == scores[1] and plain[0] == plain[1]
    many = evalml.in_fixed_order(df, "id", rows=50)
    assert many.rdd.getNumPartitions() == 3 and many.count() == 120
    with pytest.raises(ZeroDivisionError):  # a fold's error is the caller's
        evalml.at_once(spark, [lambda: 1, lambda: 1 // 0])


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")).alias("maybe"), F.lit("x").alias("side"))
    ids = lambda c: {r.id for r in df.where(c).collect()}
    many = splits.folds(F.col("id"), 4, replicas=2)
    assert len(many) == 8
    for half in (list(many)[:4], list(many)[4:]):
        tests = [ids(s.test) for s in half]
        assert set.union(*tests) == set(range(1000)) and sum(map(len, tests)) == 1000
        assert all(ids(s.train) == set(range(1000)) - t for s, t in zip(half, tests))
    assert ids(list(many)[0].test) != ids(list(many)[4].test)
    s = next(iter(splits.by_group(F.col("g"), 0.5)))
    assert {i % 7 for i in ids(s.train)}.isdisjoint({i % 7 for i in ids(s.test)}) and ids(s.train) | ids(s.test) == set(range(1000))
    s = next(iter(splits.once(F.col("maybe"), 0.3)))
    assert len(ids(s.train) | ids(s.test)) == 900 and 200 < len(ids(s.train)) < 340
    swapped = next(iter(splits.once(F.col("maybe"), 0.3).swap()))
    assert ids(swapped.train) == ids(s.test)
    assert len(many.filter(lambda s: s is not list(many)[1])) == 7
    assert ids(next(iter(many.map(lambda s: s.where(F.col("g") == 1)))).train) <= set(range(1, 1000, 7))
    assert ids(next(iter(splits.train_all())).test) == set()
    assert ids(next(iter(splits.without_rows(F.col("maybe") < 5))).test) == {1, 2, 3, 4}
    assert [ids(s.test) for s in splits.leave_out([F.col("id") == 3, F.col("maybe") == 0])] == [{3}, set()]
    with pytest.raises(Exception, match="both trains and tests"):
        ids(next(iter(splits.fixed(F.col("id") < 5, F.col("id") < 2))).train)
    table = (many + splits.train_all()).aggregate(df, total=lambda c: F.sum(F.when(c, F.col("id"))))
    rows = table.orderBy("split").collect()
    assert len(rows) == 9 and all(r.n_train + r.n_test == 1000 and (r.total_train or 0) + (r.total_test or 0) == 499500 for r in rows)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1  # nine splits, one scan
    sides = many.sides(df.select("id", "g"))
    assert sides.count() == 8000 and {tuple(r) for r in sides.groupBy("split", "side").count().where("split = 2").collect()} == {(2, "test", len(ids(list(many)[2].test))), (2, "train", 1000 - len(ids(list(many)[2].test)))}
    fitted = many.loop(df, lambda rows: rows.agg(F.avg("id")).first()[0], lambda mean, rows: rows.count())
    assert len(fitted) == 8 and sum(n for _, n in fitted) == 2000
    assert splits.Splits([]).aggregate(df).collect() == [] and splits.Splits([]).sides(df).collect() == []
