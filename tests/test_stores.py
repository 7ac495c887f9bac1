"""Sketches by day, searches by maps of files, saved models, a database, and what plans shuffle."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from sensorlens.operators import mlprep, saved_models, sessions, sketches
from sensorlens.plans.driver_log import event_log
from sensorlens.sources import readers, searchable


def test_a_day_of_sketches_is_added_alone(spark, tmp_path):
    rows = [(f"2025-01-{d:02d} 10:00:00", "ssh", f"s{k}", f"1.1.1.{k % 7}") for d in (1, 2, 3) for k in range(d * 100, d * 100 + 150)] + [("2025-01-03 11:00:00", "web", None, "")]
    log = spark.createDataFrame(rows, "t string, log_source string, session_id string, src_ip string").withColumn("timestamp", F.to_timestamp("t"))
    at = str(tmp_path / "days")
    sketches.put_days(sketches.daily_sketches(log.where("day(timestamp) < 3")), at)
    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}
    before = files()
    sketches.put_days(sketches.daily_sketches(log.where("day(timestamp) = 3")), at)
    assert before.items() <= files().items()
    whole = {r.log_source: r for r in sketches.distinct_over(sketches.stored(spark, at)).collect()}
    assert whole["ssh"].events == 450 and abs(whole["ssh"].session_id - 350) <= 4 and whole["ssh"].src_ip == 7 and (whole["web"].session_id, whole["web"].src_ip) == (0, 0)
    two = sketches.distinct_over(sketches.stored(spark, at), "2025-01-02", "2025-01-02").collect()
    assert [(r.log_source, r.events, abs(r.session_id - 150) <= 3) for r in two] == [("ssh", 150, True)]
    sketches.put_days(sketches.daily_sketches(log.where("day(timestamp) = 3")), at)  # again: replaced, not added
    assert sketches.stored(spark, at).count() == 4


def test_search_reads_few_files(spark, tmp_path):
    rows = [(k, f"Session-{k // 10:04d}-É", None if k % 9 == 0 else f"10.0.{k % 4}.{k % 250}") for k in range(2000)]
    df, at = spark.createDataFrame(rows, "id long, session_id string, src_ip string").repartitionByRange(20, "session_id"), str(tmp_path / "t")
    searchable.save_searchable(df, at, ["session_id", "src_ip"])
    for part in ("0123", "sESSION-0150-é", "0.3.2", "10.0", "nothing like it", "é", "", "session", "19-É"):
        want = {r[0] for r in rows if any(part.lower() in (c or "").lower() for c in r[1:] if c is not None)}
        got = searchable.search(spark, at, ["session_id", "src_ip"], part)
        assert {r.id for r in got.collect()} == want and got.columns == df.columns
        assert {r.id for r in searchable.search(spark, at, ["session_id"], part).collect()} == {r[0] for r in rows if part.lower() in r[1].lower()}
    few, every = searchable.files_with(spark, at, ["session_id", "src_ip"], "session-0123")
    assert every == 20 and len(few) <= 2
    assert len(searchable.search(spark, at, ["session_id", "src_ip"], "session-0123").inputFiles()) == len(few)
    assert searchable.files_with(spark, at, ["session_id"], "nothing like it") == ([], 20)


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(k, float(k % 17), None if k % 40 == 0 else float((k * k) % 101) ** 3, float("nan") if k % 33 == 0 else k / 7.0, int(k % 17 > 8), int((k * k) % 101 > 50)) for k in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, x int, y int").repartition(3).cache()


@pytest.mark.parametrize("model", ["lr", "rf", "gbt"])
def test_pipelines_score_alike_when_loaded(spark, learnable, tmp_path, model):
    features, labels = ["a", "b", "c"], ["x", "y"]
    pipeline = saved_models.fitted(learnable, features, labels, model, rounds=4)
    saved_models.save(pipeline, str(tmp_path / "m"))
    scores = lambda p: sorted(map(tuple, saved_models.probabilities(p, learnable, labels).select("id", "p_x", "p_y").collect()))
    before = scores(pipeline)
    assert before == scores(saved_models.load(str(tmp_path / "m")))
    right = sum((p > 0.5) == (k % 17 > 8) for k, p, _ in before)
    assert right > 380
    scaled = mlprep.scale(learnable, mlprep.fit_scaler(learnable, features))
    stage, columns = saved_models.scaling_stage(mlprep.fit_scaler(learnable, features))
    own = {r.id: [r[c] for c in columns] for r in stage.transform(learnable).collect()}
    assert all(own[r.id] == pytest.approx([r.a, r.b, r.c]) for r in scaled.collect())


def test_folds_of_tasks(spark, learnable, monkeypatch):
    tasks = {"x": ["x"], "y": ["y"], "both": ["x", "y"]}
    got = {(r.task, r.model, r.metric): r for r in saved_models.folds_of_tasks(learnable, ["a", "b", "c"], tasks, ["lr", "rf", "gbt"], "id", folds=3, rounds=3).collect()}
    assert set(got) == {(t, m, k) for t in tasks for m in ("lr", "rf", "gbt") for k in ("f1", "roc_auc", "average_precision")}
    assert all(len(r.per_fold) == 3 and 0 <= r["mean"] <= 1 and r["std"] >= 0 for r in got.values())
    for m in ("lr", "rf"):
        for k in range(3):
            each = [got[t, m, "f1"].per_fold[k] for t in ("x", "y", "both")]
            assert each[2] == pytest.approx((each[0] + each[1]) / 2)
    assert got["x", "rf", "f1"]["mean"] > 0.9


def test_event_database(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    rows = [(5_000_000_000 + k, f"2025-01-01 10:00:{k % 60:02d}", str(k % 9) if k % 5 else "no number", None if k % 3 else "a") for k in range(200)]
    df = spark.createDataFrame(rows, "ID long, timestamp string, severity string, username string")
    df.write.jdbc(url, "log", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = readers.event_database(spark, url, "log", "ID", parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 51
    read = {r.ID: (r.severity, r.username) for r in got.collect()}
    assert read == {r[0]: (int(r[2]) if r[2] != "no number" else None, r[3] or "") for r in rows}


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", final)), final


def test_sessions_shuffle_the_events_once(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, plan = exchanges(sessions.sessionize(event_log(spark, data)))
        assert n <= 4, plan  # the events, their keys and times, and two of the rows of days
        n, plan = exchanges(sessions.build_sessions(event_log(spark, data)))
        assert n <= 6, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sessionize_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "b", "2025-01-01 10:00:00", "keep", "k")], "id long, src_ip string, dest_ip string, t string, _day string, _key string").withColumn("timestamp", F.to_timestamp("t"))
    row = sessions.sessionize(df).first()
    assert (row["_day"], row["_key"], row["session"]) == ("keep", "k", "a::b::s1")


