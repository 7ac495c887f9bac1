"""Models that outlive their session: cleaning, scaling and a classifier for each label as one pipeline, saved and loaded whole.

The fitted scaler becomes a stage of SQL, each classifier writes columns of its own, and so one pass over the sessions gives the
probabilities of all labels. Folds over tasks and models refit all of it, scaler too, on the rows of each fold.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import settled
from . import metrics, mlprep, train

VECTOR = "scaled_features"


def scaling_stage(scaler: DataFrame) -> tuple[SQLTransformer, list[str]]:
    """What ``mlprep.scale`` does, as a stage: each feature of ``scaler`` cleaned, logged where fitted so and scaled, in a column of its own."""
    columns, made = [], []
    for k, r in enumerate(sorted(scaler.collect(), key=lambda r: r["feature"])):  # a row for each feature
        value = f"CAST(`{r.feature}` AS DOUBLE)"
        clean = f"CASE WHEN {value} IS NULL OR isnan({value}) OR abs({value}) = double('infinity') THEN 0D ELSE {value} END"
        logged = f"log1p(greatest({clean}, 0D))" if r.log1p else clean
        made.append(f"({logged} - {r['mean']!r}D) / {r['scale']!r}D AS scaled_{k}")
        columns.append(f"scaled_{k}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__"), columns


def _classifier(ready: DataFrame, label: str, model: str, rounds: int) -> Model:
    made = train.fit_vectors(ready, label, model, rounds, VECTOR)
    return made.setRawPredictionCol(f"raw_{label}").setProbabilityCol(f"probability_{label}").setPredictionCol(f"prediction_{label}")


def fitted(rows: DataFrame, features: list[str], labels: list[str], model: str, rounds: int = 200) -> PipelineModel:
    """Scaler and a classifier of kind ``model`` for each of ``labels``, fitted on ``rows``."""
    stage, columns = scaling_stage(mlprep.fit_scaler(rows, features))
    assembler = VectorAssembler(inputCols=columns, outputCol=VECTOR, handleInvalid="keep")
    ready = assembler.transform(stage.transform(rows)).select(VECTOR, *labels).persist()
    ready.count()  # side by side, each would compute it
    made = train.side_by_side(ready, [partial(_classifier, ready, y, model, rounds) for y in labels])
    ready.unpersist()
    return PipelineModel([stage, assembler, *made])


def save(pipeline: PipelineModel, path: str) -> None:
    pipeline.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probabilities(pipeline: PipelineModel, sessions: DataFrame, labels: list[str]) -> DataFrame:
    """``sessions`` with ``p_`` and each label, all in one pass."""
    scored = pipeline.transform(sessions)
    return scored.select(*(F.col(f"`{c}`") for c in sessions.columns), *(F.get(vector_to_array(f"probability_{y}"), 1).alias(f"p_{y}") for y in labels))


def folds_of_tasks(df: DataFrame, features: list[str], tasks: dict[str, list[str]], models: list[str], key: str, folds: int = 5, rounds: int = 200, at_once: int = 1) -> DataFrame:
    """``task, model, metric, mean, std, per_fold``: each fold scored by pipelines fitted on the others, scaler and all.

    A task of one label has its F1 (mean of both classes), ROC-AUC and average precision; one of several has their means.
    Folds keep the shares of the first task's label. A label is fitted once for a fold and model, whatever tasks it is in;
    ``at_once`` of them are fitted side by side, which takes memory of the driver.
    """
    labels = sorted({y for ys in tasks.values() for y in ys})
    rows = settled(mlprep.stratified_folds(df, next(iter(tasks.values()))[0], key, folds).select("fold", *features, *labels), "folds")
    scaling = train.side_by_side(rows, [lambda k=k: scaling_stage(mlprep.fit_scaler(rows.where(F.col("fold") != k), features)) for k in range(folds)], at_once)
    columns = scaling[0][1]
    # Folders of a fold each: what reads them has no figures of a fold in its plan, so all folds run the same compiled code.
    each = [stage.transform(rows).select(*columns, *labels, (F.col("fold") == k).alias("held"), F.lit(k).alias("of")) for k, (stage, _) in enumerate(scaling)]
    scaled = settled(reduce(DataFrame.unionByName, each), "scaled", ("of", "held"))

    def one(model: str, fold: int) -> DataFrame:
        fitting, asked = (scaled.where((F.col("of") == fold) & (F.col("held") == held)).select(*columns, *labels) for held in (False, True))
        scored = train.held_out(fitting, asked, columns, labels, model, rounds, at_once=1)
        return scored.withColumns({"fold": F.lit(fold), "model": F.lit(model), "label": F.col("label").cast("int"), "prediction": F.col("prediction").cast("int"), "score": F.round("score", 9)})

    parts = train.side_by_side(rows, [partial(one, m, k) for m in models for k in range(folds)], at_once)
    out = settled(reduce(DataFrame.unionByName, parts), "scored")
    keys = ["fold", "model", "label_name"]
    figures = metrics.binary_metrics(out, keys).select(*keys, "f1").join(metrics.ranking_metrics(out, keys), keys)
    named = F.create_map(*(x for task, ys in tasks.items() for x in (F.lit(task), F.array(*map(F.lit, ys)))))
    by_task = figures.select("*", F.explode(named).alias("task", "of")).where(F.array_contains("of", F.col("label_name")))
    means = by_task.groupBy("task", "model", "fold").agg(*(F.avg(m).alias(m) for m in ("f1", "roc_auc", "average_precision")))
    long = means.unpivot(["task", "model", "fold"], ["f1", "roc_auc", "average_precision"], "metric", "value")
    return metrics.over_folds(long, ["task", "model", "metric"])
