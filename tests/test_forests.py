"""Held-out scores by forests over cells, and what the model queries read."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from sensorlens.operators import forest, mlprep, saved_models, train


@pytest.fixture(scope="module")
def noisy(spark):
    draw = np.random.default_rng(7)
    x = draw.random((1200, 3)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(0, 0.2, len(x)) > 0.8).astype(int)
    rows = [(k, *map(float, x[k]), float(max(0, k % 40 - 36)), int(y[k])) for k in range(len(x))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").repartition(5).cache()


def _counted(spark, rows):
    """``rows`` whose column ``a`` counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    return rows.withColumn("a", F.udf(told, "double").asNondeterministic()("a")), seen


def test_folds_of_tasks_compute_their_input_once(spark, noisy):
    rows, seen = _counted(spark, noisy)
    assert saved_models.folds_of_tasks(rows, ["a", "b"], {"y": ["y"]}, ["lr", "rf"], "id", folds=3, rounds=3).count() == 6
    assert seen.value == 1200


def test_scores_are_those_of_a_forest(spark, noisy, monkeypatch):
    rows, columns = mlprep.stratified_folds(noisy, "y", "id", 4), ["a", "b", "c", "d"]
    fitting, asked = rows.where("fold <> 0"), rows.where("fold = 0")
    ready, both = mlprep.class_weights(train.assembled(fitting, columns, "y"), "label"), asked.select("id", "y")
    for seed in (42, 7):
        model = train.FACTORIES["rf"](900, 60).setSeed(seed).fit(ready.select("features", "label", "weight"))
        both = both.join(train.scored(model, asked, columns, "y").select("id", F.col("score").alias(f"s{seed}")), "id")
    points = [sorted({float(t) for t in re.findall(rf"feature {k} <= ([-\d.E]+)\)", model.toDebugString)}) for k in range(4)]
    for name, given in (("own", forest.split_points), ("p", lambda *a: points)):  # by own split points, and by MLlib's
        monkeypatch.setattr(forest, "split_points", given)
        out = train.held_out(fitting, asked, columns, ["y"], "rf", 60)
        both = both.join(out.select("id", F.col("score").alias(name), F.col("prediction").alias(f"says_{name}")), "id")
    both = both.toPandas()
    assert len(both) == asked.count() and ((both.p > 0.5) == (both.says_p == 1)).all()
    alike, usual = np.corrcoef(both.p, both.s42)[0, 1], np.corrcoef(both.s7, both.s42)[0, 1]
    assert alike > usual - 0.01 and np.corrcoef(both.own, both.s42)[0, 1] > 0.95, (alike, usual)  # as two of MLlib's by different seeds
    right = {k: ((both[k] > 0.5) == (both.y == 1)).mean() for k in ("p", "own", "s42")}
    assert min(right["p"], right["own"]) > right["s42"] - 0.03
    again = train.held_out(fitting.repartition(9), asked, columns, ["y"], "rf", 60).select("id", F.col("score").alias("q")).toPandas().merge(both, on="id")
    assert again.q.to_numpy() == pytest.approx(again.p.to_numpy())


def test_more_cells_than_go_to_tasks(spark, noisy, monkeypatch):
    estimator = RandomForestClassifier(numTrees=3, maxDepth=4, seed=1)
    monkeypatch.setattr(forest, "CELLS", 50)
    assert forest.scores(noisy, noisy, ["a", "b", "c"], ["y"], estimator) is None
    rows = mlprep.stratified_folds(noisy, "y", "id", 2)
    assert train.held_out(rows.where("fold = 0"), rows.where("fold = 1"), ["a", "b", "c"], ["y"], "rf", 3).select("label", "prediction", "score").count() == rows.where("fold = 1").count()


def test_split_points_share_out_what_a_frequent_value_leaves(spark):
    rows = spark.createDataFrame([(float(max(0, k - 900)), float(k % 3), 5.0) for k in range(1000)], "a double, b double, c double")
    a, b, c = forest.split_points(rows, ["a", "b", "c"], 9)
    assert a[0] == 0 and len(a) == 9 and max(np.diff([0, *a[1:], 99])) <= 25
    assert (b, c) == ([0.0, 1.0, 2.0], [5.0])
    got = forest.binned(rows, ["a", "b", "c"], [[0.0, 10.0], [1.0], []]).select("a", "b", "bins").distinct().collect()
    assert all(r.bins == [(r.a > 0) + (r.a > 10), int(r.b > 1), 0] for r in got)


def test_a_tree_of_all_features_knows_its_cells():
    draw = np.random.default_rng(3)
    bins = np.unique(draw.integers(0, 32, (3000, 3)).astype(np.uint8), axis=0)
    y = (bins[:, 0] > 11) ^ (bins[:, 1] % 5 > 2) | (bins[:, 2] > 28)
    p = forest.grown(bins, np.where(y, 0.0, 2.0), np.where(y, 3.0, 0.0), 3, 30, np.random.default_rng(1))
    assert ((p > 0.5) == y).all() and set(np.round(p, 6)) == {0.0, 1.0}
    few = forest.grown(bins, np.where(y, 0.0, 2.0), np.where(y, 3.0, 0.0), 3, 2, np.random.default_rng(1))
    assert len(set(few)) <= 4
    assert set(forest.grown(bins, np.full(len(bins), 1.0), np.zeros(len(bins)), 2, 30, draw)) == {0.0}
    # Leaves of one prediction become their parent, and say what all its rows say.
    flat = forest.grown(np.array([[0], [1], [2]], np.uint8), np.array([4.0, 9.0, 8.0]), np.array([1.0, 0.0, 1.0]), 1, 30, draw)
    assert flat == pytest.approx([2 / 23] * 3)


def test_cross_validation_computes_its_input_once(spark, noisy):
    rows, seen = _counted(spark, noisy)
    assert len(train.cross_validate(rows, ["a", "b"], "y", "id", "rf", folds=3, rounds=3).first().per_fold) == 3
    assert seen.value == 1200


def test_evaluation_computes_its_input_once(spark, noisy):
    rows, seen = _counted(spark, noisy)
    splits = mlprep.stratified_split(rows, "y", "id")
    assert train.evaluate(splits, ["a", "b"], ["y"], ["lr", "rf"], rounds=3).count() == 4
    assert seen.value == 1200
