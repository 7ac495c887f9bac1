"""The model queries fit the models that SURVEY (M06, M07, M15) names."""

from __future__ import annotations

from sensorlens.operators import anomaly, train
from sensorlens.plans import registry


def test_sizes(spark, data, monkeypatch):
    seen = {}
    monkeypatch.setattr(train, "evaluate", lambda *a, rounds=200: seen.update(evaluate=rounds))
    monkeypatch.setattr(train, "cross_validate", lambda *a, folds=5, rounds=200: seen.update(cross_validate=rounds))
    monkeypatch.setattr(anomaly, "fit", lambda *a, trees=200: seen.update(forest=trees))
    monkeypatch.setattr(anomaly, "score", lambda df, *a: df.selectExpr("*", "0.0 score"))
    for name in ("train_models", "cross_validation", "isolation_forest"):
        registry.QUERIES[name](spark, data)
    assert seen == {"evaluate": 200, "cross_validate": 200, "forest": 200}
    assert train.FACTORIES["rf"](100, 200).getMaxDepth() == 30
