"""Classifiers with MLlib: logistic regression, random forest and boosted trees, for one label or several."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import settled
from . import forest, metrics, mlprep

#: Estimators by name; more can be added.
FACTORIES: dict[str, Callable] = {
    "lr": lambda n, rounds: LogisticRegression(weightCol="weight", labelCol="label", regParam=1.0 / max(1, n), standardization=False, maxIter=1000),
    "rf": lambda n, rounds: RandomForestClassifier(weightCol="weight", labelCol="label", numTrees=rounds, maxDepth=30, seed=42),
    "gbt": lambda n, rounds: GBTClassifier(weightCol="weight", labelCol="label", maxIter=rounds, maxDepth=6, stepSize=0.1, seed=42),
}
LEAST_POSITIVES = 50
ROWS_A_TASK = 100_000
#: Models that are fitted side by side.
AT_ONCE = 8


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(mlprep.cleaned(df, features))


def assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return vectors(df, features).withColumn("label", F.col(label).cast("double"))


def fit_vectors(rows: DataFrame, label: str, model: str, rounds: int = 200, vector: str = "features") -> Model:
    """A classifier of ``label``, fitted on ``rows`` whose features are in ``vector``."""
    rows = rows.select(vector, F.col(label).cast("double").alias("label"))
    n = sum((counts := mlprep.class_counts(rows, "label")).values())
    # Trees take hundreds of small jobs one after the other: tasks of few rows would only cost their start.
    return FACTORIES[model](n, rounds).setFeaturesCol(vector).fit(mlprep.class_weights(rows, "label", counts=counts).coalesce(max(1, -(-n // ROWS_A_TASK))))


def fit(train: DataFrame, features: list[str], label: str, model: str, rounds: int = 200) -> Model:
    return fit_vectors(vectors(train, features), label, model, rounds)


def side_by_side(df: DataFrame, jobs: list[Callable], at_once: int = AT_ONCE) -> list:
    """What ``jobs`` return, in their order; a single fit's small jobs leave most cores idle."""
    own = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(at_once) as pool:
        return [x.result() for x in [pool.submit(own(job)) for job in jobs]]


def _with_score(out: DataFrame) -> DataFrame:
    return out.withColumn("score", F.get(vector_to_array("probability"), 1)).drop("rawPrediction", "probability")


def scored(model: Model, df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``df`` with ``label``, ``prediction`` and ``score``, the probability of 1."""
    return _with_score(model.transform(assembled(df, features, label)))


def eligible(train: DataFrame, labels: list[str], least: int = LEAST_POSITIVES) -> list[str]:
    row = train.agg(*(F.count_if(F.col(y) == 1).alias(y) for y in labels)).first()
    return [y for y in labels if row[y] >= least]


def held_out(train: DataFrame, rest: DataFrame, features: list[str], labels: list[str], model: str, rounds: int = 200, at_once: int = AT_ONCE) -> DataFrame:
    """``rest`` without ``features``, with ``label_name``, ``label``, ``prediction`` and ``score`` for each of ``labels``, by classifiers fitted on ``train``; features are numbers."""
    estimator, own = FACTORIES[model](1, rounds), [c for c in rest.columns if c not in (*features, *labels)]
    if isinstance(estimator, RandomForestClassifier) and (out := forest.scores(train, rest, features, labels, estimator)) is not None:
        return out.drop(*features)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    train, rest = assembler.transform(train), assembler.transform(rest)
    made = side_by_side(rest, [partial(fit_vectors, train, y, model, rounds) for y in labels], at_once)
    parts = [_with_score(m.transform(rest)).select(*own, F.lit(y).alias("label_name"), F.col(y).cast("double").alias("label"), "prediction", "score") for y, m in zip(labels, made, strict=True)]
    return reduce(DataFrame.unionByName, parts)


def evaluate(splits: DataFrame, features: list[str], labels: list[str], models: list[str], rounds: int = 200) -> DataFrame:
    """``label_name, model, split`` and metrics: one model for each label and kind, fitted on split 'train'."""
    rows = settled(mlprep.cleaned(splits, features).select("split", *features, *labels), "splits")
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    parts = side_by_side(rows, [partial(held_out, train, rest, features, labels, m, rounds) for m in models])
    parts = [p.withColumns({"score": F.round("score", 9), "model": F.lit(m)}) for m, p in zip(models, parts, strict=True)]
    out, keys = settled(reduce(DataFrame.unionByName, parts), "scored"), ["label_name", "model", "split"]
    return metrics.binary_metrics(out, keys).join(metrics.ranking_metrics(out, keys), keys)


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, model: str, folds: int = 5, rounds: int = 200) -> DataFrame:
    """F1 over folds: each is scored by a model of the others."""
    rows = settled(mlprep.cleaned(mlprep.stratified_folds(df, label, key, folds), features).select("fold", *features, label), "folds")
    parts = side_by_side(rows, [partial(held_out, rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), features, [label], model, rounds) for k in range(folds)])
    each = metrics.binary_metrics(reduce(DataFrame.unionByName, parts), ["fold"]).select("fold", F.lit(model).alias("model"), F.col("f1").alias("value"))
    return metrics.over_folds(each, ["model"])


def importances(model: Model, features: list[str], spark) -> DataFrame:
    """``feature, importance, rank, dominant``: shares of a tree model, or sizes of coefficients."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    total = float(sum(values)) or 1.0
    rows = sorted(((f, float(v)) for f, v in zip(features, values, strict=True)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, v, k + 1, v / total > 0.5) for k, (f, v) in enumerate(rows)], "feature string, importance double, rank int, dominant boolean")


def mean_importances(each: DataFrame, labels: int) -> DataFrame:
    """``feature, importance``: the mean over ``labels`` models of ``feature, importance`` rows; a feature that a model lacks is 0 there."""
    return each.groupBy("feature").agg((F.sum("importance") / labels).alias("importance"))


def predict_attacks(models: dict[str, Model], sessions: DataFrame, features: list[str], at: float = 0.5) -> DataFrame:
    """``sessions`` with a probability for each model's name and the names at or over ``at``, likeliest first."""
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(mlprep.cleaned(sessions, features))
    for name, model in models.items():
        out = model.transform(out).withColumn(f"p_{name}", F.get(vector_to_array("probability"), 1)).drop("rawPrediction", "probability", "prediction")
    pairs = F.array(*(F.struct((-F.col(f"p_{n}")).alias("p"), F.lit(n).alias("n")) for n in models))
    names = F.transform(F.filter(F.array_sort(pairs), lambda x: -x["p"] >= at), lambda x: x["n"])
    return out.withColumn("attacks", names).drop("features")
