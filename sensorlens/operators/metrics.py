"""Metrics of classifiers as aggregates. Scored rows: keys, ``label`` 0/1, ``prediction`` 0/1, ``score``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import ranks


def _counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    return scored.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(tp, fp, fn):
    return _ratio(2 * tp, 2 * tp + fp + fn), _ratio(tp, tp + fp), _ratio(tp, tp + fn)


def binary_metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, and F1, precision and recall of both classes' mean and of the positive class; 0 where nothing divides."""
    keys = keys or []
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = _scores(tp, fp, fn), _scores(tn, fn, fp)
    names = ("f1", "precision", "recall")
    macro = [((a + b) / 2).alias(n) for a, b, n in zip(pos, neg, names, strict=True)]
    return _counts(scored, keys).select(*keys, "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), *macro, *(p.alias(f"positive_{n}") for p, n in zip(pos, names, strict=True)))


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each different score, and of all greater or equal ones."""
    grouped = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return ranks.running(grouped, keys, ranks.by_size(scored, "score"), [F.col("score").desc()], {"cum_pos": "pos", "cum_neg": "neg"}, down=True)


def ranking_metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ROC-AUC, equal scores counted half, and average precision by steps; null where there is one class only."""
    keys = keys or []
    steps = _by_score(scored, keys)
    below = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0))
    precise = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return steps.groupBy(*keys).agg(F.when(both, below / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"), F.when(both, precise / F.sum("pos")).alias("average_precision"))


def multilabel_metrics(scored: DataFrame, label: str = "name") -> DataFrame:
    """Means, over labels, of the positive class's F1, precision and recall, beside the means of both-class ones."""
    each = binary_metrics(scored, [label])
    return each.agg(F.count("*").alias("labels"), *(F.avg(f"positive_{n}").alias(f"macro_{n}") for n in ("f1", "precision", "recall")), F.avg("f1").alias("mean_label_f1"))


def always_negative(scored: DataFrame) -> DataFrame:
    """What a classifier that says 0 to all would reach."""
    return scored.agg(F.count("*").alias("total"), F.avg((F.col("label") == 0).cast("double")).alias("accuracy"), F.lit(0.0).alias("recall"))


def over_folds(metrics: DataFrame, keys: list[str], value: str = "value", fold: str = "fold") -> DataFrame:
    """Mean, deviation (of the population) and the list by fold; missing values are left out."""
    rows = metrics.where(F.col(value).isNotNull())
    listed = F.transform(F.array_sort(F.collect_list(F.struct(fold, value))), lambda x: x[value])
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), listed.alias("per_fold"))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """By label: rows, mean, least and greatest score, and share flagged (detection, or false alarms)."""
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg(F.col("prediction").cast("double")).alias("flagged"))


def best_model(metrics: DataFrame, order: list[str]) -> DataFrame:
    """The model of the greatest F1; the first in ``order`` of equals."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return metrics.agg(F.max_by("model", F.struct(F.col("f1"), -place)).alias("model"))
