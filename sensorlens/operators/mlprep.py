"""Training data: balance, exact stratified splits and folds, skew, scaling, and a gate against leakage."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import HEURISTIC_FEATURES
from . import ranks

WARN_RATIO = 20


def unpivot(df: DataFrame, columns: list[str], name: str = "label", value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keep), columns, name, value)


def imbalance_report(df: DataFrame, labels: list[str]) -> DataFrame:
    """For each label positives, negatives, total, percentage, negatives to a positive (null if there is none) and a warning."""
    long = unpivot(df, labels).where("value is not null").groupBy("label").agg(F.count_if(F.col("value") == 1).alias("positive"), F.count("*").alias("total"))
    negative = F.col("total") - F.col("positive")
    ratio = F.when(F.col("positive") > 0, negative / F.col("positive"))
    return long.select("label", "positive", negative.alias("negative"), "total", (F.col("positive") / F.col("total") * 100).alias("positive_pct"), ratio.alias("ratio"), F.coalesce(ratio > WARN_RATIO, F.lit(True)).alias("imbalanced"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


def _shuffled(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``df`` with ``_place``, from 1 in an order of each label drawn by a hash of ``key``, and ``all__place``, the label's rows."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    drawn = df.withColumn("_draw", draw)
    return ranks.running(drawn, [label], F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int"), [F.col("_draw"), F.col(key)], {"_place": None}).drop("_draw")


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.70, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exact shares of each label value, in an order drawn by a hash of ``key``."""
    place = (F.col("_place") - 1) / F.col("all__place")
    split = F.when(place < train, "train").when(place < train + validation, "val").otherwise("test")
    return _shuffled(df, label, key, seed).withColumn("split", split).drop("_place", "all__place")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return _shuffled(df, label, key, seed).withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place", "all__place")


def cleaned(df: DataFrame, features: list[str]) -> DataFrame:
    """Infinite, missing and no-number values become 0."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns({c: F.coalesce(F.when(F.abs(value(c)) == float("inf"), 0.0).otherwise(value(c)), F.lit(0.0)) for c in features})


def skew(column: str | Column) -> Column:
    """Bias-corrected skewness, as an aggregate."""
    c = F.col(column) if isinstance(column, str) else column
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n.cast("double") * (n - 1)) / (n - 2))


def fit_scaler(train: DataFrame, features: list[str], skew_over: float = 2.0) -> DataFrame:
    """``feature, log1p, mean, scale``: two passes over the training rows; a feature without spread has scale 1."""
    rows = cleaned(train, features)
    skews = rows.agg(*(skew(f).alias(f) for f in features)).first()
    logs = {f for f in features if not f.startswith("log_") and skews[f] is not None and not math.isnan(skews[f]) and abs(skews[f]) > skew_over}
    return _moments(logged(rows, logs), features, logs)


def _moments(rows: DataFrame, features: list[str], logs: set[str]) -> DataFrame:
    sums = rows.agg(*(x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))))
    entries = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(f in logs).alias("log1p"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0).alias("scale")) for f in features))
    return sums.select(F.explode(entries).alias("e")).select("e.*")


def logged(df: DataFrame, logs: set[str]) -> DataFrame:
    return df.withColumns({f: F.log1p(F.greatest(F.col(f), F.lit(0.0))) for f in logs}) if logs else df


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """``df`` with the features of ``scaler`` (a row for each feature) cleaned, logged where fitted so, and scaled."""
    state = {r["feature"]: r for r in scaler.collect()}
    rows = logged(cleaned(df, list(state)), {f for f, r in state.items() if r["log1p"]})
    return rows.withColumns({f: (F.col(f) - r["mean"]) / r["scale"] for f, r in state.items()})


def save_scaler(scaler: DataFrame, path: str) -> None:
    """One row for each feature, so one file does."""
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, log1p boolean, mean double, scale double").parquet(path)


def prevalence(df: DataFrame, labels: list[str]) -> DataFrame:
    """``label, positive``, one row for each label, and one named ``unlabelled`` for the rows without any."""
    none = reduce(lambda a, b: a & b, [F.coalesce(F.col(y), F.lit(0)) == 0 for y in labels])
    row = df.agg(*(F.count_if(F.col(y) == 1).alias(y) for y in labels), F.count_if(none).alias("unlabelled"))
    return row.unpivot([], [*labels, "unlabelled"], "label", "positive")


def correlations(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """``feature, label, corr`` for all pairs, in one pass."""
    pairs = [(f, y) for f in features for y in labels]
    row = df.agg(*(F.corr(F.col(f).cast("double"), F.col(y).cast("double")).alias(f"c{k}") for k, (f, y) in enumerate(pairs)))
    entries = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label"), F.col(f"c{k}").alias("corr")) for k, (f, y) in enumerate(pairs)))
    return row.select(F.explode(entries).alias("e")).select("e.*")


def leaks(features: list[str], labels: list[str], df: DataFrame | None = None, threshold: float = 0.98) -> list[str]:
    """Names of features that are labels, that labels are made from, or that follow a label too closely in ``df``."""
    bad = [f for f in features if f in labels or f.startswith("label_") or f in HEURISTIC_FEATURES]
    if df is not None:
        bad += [r["feature"] for r in correlations(df, [f for f in features if f not in bad], labels).where(F.abs("corr") > threshold).collect()]
    return sorted(set(bad))


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def class_weights(df: DataFrame, label: str, name: str = "weight", counts: dict | None = None) -> DataFrame:
    """``df`` with a balanced weight: rows / (2 * rows of the class)."""
    counts = class_counts(df, label) if counts is None else counts
    total = sum(counts.values())
    # A map goes beside the compiled code, not into it, so that fits on other rows run the same code.
    weights = F.create_map(*(F.lit(x) for value, n in counts.items() if value is not None for x in (value, total / (2.0 * n))))
    return df.withColumn(name, F.coalesce(F.element_at(weights, F.col(label)), F.lit(1.0)) if set(counts) - {None} else F.lit(1.0))
