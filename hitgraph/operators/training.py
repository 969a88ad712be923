"""Supervised evaluation: what is learnt from a fold's training rows, transforms included, is replayed on the others."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls
from . import evalml
from .splits import premade
from .written import materialize


def _moments(df: DataFrame, column: str) -> list:
    """(position, mean, sd) of an array column's places, ascending: as many rows as the arrays are long."""
    each = df.select(F.posexplode(F.col(column)).alias("at", "x"))
    return sorted(each.groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).collect())


class _Columns(HasInputCol, HasOutputCol):
    def _of(self, inputCol: str, outputCol: str):  # noqa: N803  Spark ML's own names
        return self._set(inputCol=inputCol, outputCol=outputCol)


class DropConstant(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns which places of an array column vary: those of standard deviation 0, NaN or NULL go."""

    def __init__(self, inputCol: str = "features", outputCol: str = "kept") -> None:  # noqa: N803
        super().__init__()
        self._of(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> DropConstantModel:
        kept = [r["at"] for r in _moments(df, self.getInputCol()) if r["sd"] is not None and r["sd"] == r["sd"] and r["sd"] > 0]
        return DropConstantModel(self.getInputCol(), self.getOutputCol())._set(places=kept)


class DropConstantModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    places = Param(Params._dummy(), "places", "places of the array that are kept", TypeConverters.toListInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "kept") -> None:  # noqa: N803
        super().__init__()
        self._of(inputCol, outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = F.array(*[F.lit(p) for p in self.getOrDefault(self.places)]).cast("array<int>")
        return df.withColumn(self.getOutputCol(), F.transform(kept, lambda p: F.get(F.col(self.getInputCol()), p).cast("double")))


class Standardise(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns each place's mean and sample standard deviation; a constant place becomes 0."""

    def __init__(self, inputCol: str = "features", outputCol: str = "scaled") -> None:  # noqa: N803
        super().__init__()
        self._of(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> StandardiseModel:
        rows = _moments(df, self.getInputCol())
        return StandardiseModel(self.getInputCol(), self.getOutputCol())._set(means=[float(r["mean"]) for r in rows], sds=[float(r["sd"] or 0.0) for r in rows])


class StandardiseModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean by place", TypeConverters.toListFloat)
    sds = Param(Params._dummy(), "sds", "standard deviation by place", TypeConverters.toListFloat)

    def __init__(self, inputCol: str = "features", outputCol: str = "scaled") -> None:  # noqa: N803
        super().__init__()
        self._of(inputCol, outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        mean, sd = (F.array(*[F.lit(float(x)) for x in self.getOrDefault(p)]) for p in (self.means, self.sds))
        shifted = F.zip_with(F.col(self.getInputCol()), mean, lambda x, m: x.cast("double") - m)
        return df.withColumn(self.getOutputCol(), F.zip_with(shifted, sd, lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0))))


class ToVector(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """An array column as Spark ML's vectors."""

    def __init__(self, inputCol: str = "kept", outputCol: str = "vector") -> None:  # noqa: N803
        super().__init__()
        self._of(inputCol, outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol())))


def forest(vector: str, target: str, width: int, trees: int = 500, seed: int = 0) -> Pipeline:
    """Constant places dropped, then a forest that tries sqrt(features + 1) of them at a split; can be saved and loaded, fitted too."""
    from pyspark.ml.classification import RandomForestClassifier

    learner = RandomForestClassifier(featuresCol="_vector", labelCol=target, probabilityCol="_chance", rawPredictionCol="_raw", predictionCol="_class", numTrees=trees, featureSubsetStrategy=str(max(1, int((width + 1) ** 0.5))), seed=seed)
    return Pipeline(stages=[DropConstant(vector, "_kept"), ToVector("_kept", "_vector"), learner])


class Evaluation(NamedTuple):
    """scores: key, p (geometric mean over folds of the probability of class 1); metrics: a row a fold; models: fitted by fold."""

    scores: DataFrame
    metrics: DataFrame
    models: list[PipelineModel]


def supervised_eval(features: DataFrame, targets: DataFrame, key: str, vector: str, target: str, folds: int = 3, trees: int = 500, seed: int = 0, pipeline=None) -> Evaluation:
    """Cross-validated scores of every row that has features, and each fold's metrics on its held-out targets.

    features: key (unique integer), an array column (rows with a NULL or NaN component drop); targets: key, 0 or 1.
    Folds are stratified by target, repeatable and fitted side by side.  Each fold's pipeline is fitted on its training rows alone, gives
    the probabilities of its held-out rows (fold, auc1, ap1, threshold1, n_true, n_false) and of all rows with features,
    with and without target.  `pipeline(vector, target column, width)` may give another Spark ML pipeline whose
    model writes probabilities to _chance.  Raises if a fold holds out rows of one class only.
    """
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    every = materialize(features.where(F.coalesce(whole, F.lit(False)) & F.col(key).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("_features")))
    one = every.first()
    if one is None:
        raise ValueError("no row has features")
    known = every.join(targets.where(F.col(target).isNotNull()).select(key, F.col(target).cast("double").alias("_target")), key)
    dealt = evalml.in_fixed_order(materialize(evalml.stratified_folds(known, "_target", key, folds, seed)), key).persist()
    make = pipeline or (lambda v, t, width: forest(v, t, width, trees, seed))
    chance = nulls.nan_to_null(vector_to_array("_chance")[1])

    def fitted(fold, split):
        model = make("_features", "_target", len(one["_features"])).fit(dealt.where(split.train))
        held = materialize(model.transform(dealt.where(split.test)).select(key, chance.alias("p"), (F.col("_target") == 1).alias("true")))
        return model, evalml.two_class_metrics(held, "p", "true", key).select(F.lit(fold).cast("long").alias("fold"), "*")

    try:
        got = evalml.at_once(features.sparkSession, [lambda fold=fold, split=split: fitted(fold, split) for fold, split in enumerate(premade(F.col("fold"), folds))])
    finally:
        dealt.unpersist()
    models = [model for model, _ in got]
    scored = [model.transform(every).select(key, nulls.safe_ln(chance).alias("_l")) for model in models]
    scores, metrics = reduce(DataFrame.unionByName, scored), reduce(DataFrame.unionByName, [m for _, m in got])
    return Evaluation(scores.groupBy(key).agg(F.exp(F.avg("_l")).alias("p")), metrics, models)
