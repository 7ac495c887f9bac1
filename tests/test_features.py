"""Golden values and invariants of sessions, features, labels, splits, metrics and models."""

from __future__ import annotations

import math
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorlens.functions import net, text as T
from sensorlens.operators import anomaly, corpus, evaluation, features, labels, metrics, mlprep, sessions, soc, train
from sensorlens.plans.behaviour import session_intelligence
from sensorlens.schemas import LABELS
from sensorlens.sources import sinks


def test_entropies(spark):
    row = spark.range(1).select(T.char_entropy(F.lit("aab")).alias("a"), T.list_entropy(F.array(F.lit("a"), F.lit("b"))).alias("b"), T.char_entropy(F.lit("")).alias("c"), T.char_entropy(F.lit("aaa")).alias("d")).first()
    assert row.a == pytest.approx(0.918296, abs=1e-6) and row.b == 1.0 and row.c == 0.0 and row.d == 0.0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab |;&$`.-/Éi0wgetcurlhmodx\n", max_size=40), min_size=200, max_size=200))
def test_patterns_agree_with_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", *(T.flag(F.col("t"), p, c).alias(n) for n, (p, c) in T.COMMAND_FLAGS.items())).collect()
    for r in got:
        for n, (p, c) in T.COMMAND_FLAGS.items():
            assert r[n] == int(bool(re.search(p, texts[r.k], 0 if c else re.I))), (n, texts[r.k])


def _event(k, at, **columns):
    base = dict.fromkeys(("username", "password", "request_data", "dns_query", "http_uri", "http_user_agent", "alert_type", "protocol"))
    return {"id": k, "timestamp": datetime(2025, 1, 1) + timedelta(seconds=at), "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "log_source": "cowrie", "event_type": "ssh_command", "dest_port": 22, **base, **columns}


SCHEMA = "id long, timestamp timestamp, src_ip string, dest_ip string, log_source string, event_type string, dest_port int, username string, password string, request_data string, dns_query string, http_uri string, http_user_agent string, alert_type string, protocol string"


def test_gap_at_the_boundary(spark):
    rows = spark.createDataFrame([_event(1, 0), _event(2, 1800), _event(3, 3601), _event(4, 3601)], SCHEMA)
    got = [(r.id, r.session[-2:]) for r in sessions.sessionize(rows).orderBy("id").collect()]
    assert got == [(1, "s1"), (2, "s1"), (3, "s2"), (4, "s2")]


def test_session_intelligence(spark):
    rows = [
        _event(1, 0, event_type="ssh_connect"), _event(2, 0.3, event_type="ssh_login_failed", username="Root", password="toor"), _event(3, 6, event_type="ssh_login_success", username="root", password="x"),
        _event(4, 7, request_data="wget http://a/b"), _event(5, 8, request_data="chmod +x b"), _event(6, 9, request_data="cat x | sh"), _event(7, 10, request_data=""), _event(8, 11, dns_query="a.b.c.d.e.f"),
    ]
    r = session_intelligence(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.commands == ["", "wget http://a/b", "chmod +x b", "cat x | sh"] and r.event_types[:3] == ["ssh_connect", "ssh_login_failed", "ssh_login_success"]
    assert (r.burst_count, r.cmd_count, r.has_download_execute_chain, r.has_default_creds, r.dns_tunnel_indicator) == (1, 4, 1, 1, 1)
    assert r.credential_attempts == 3 and r.label_brute_force == 1 and r.label_tunneling == 1 and r.tunnel_label == 1 and r.label_network_probe == 0
    assert r.avg_inter_cmd_delay == pytest.approx(11 / 7) and r.log_source == "cowrie"


def test_sensor_sessions(spark):
    rows = [_event(1, 0, request_data="a"), _event(2, 4000, request_data="b"), _event(3, 4001, request_data="a"), _event(4, 5000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("session_id", F.lit("x"))
    r = features.session_features(sessions.sensor_sessions(df, "x")).first()
    assert (r.event_count, r.commands, r.max_inter_cmd_delay, r.cmd_count, r.src_ip) == (4, ["a", "b", ""], 4000.0, 2, "1.1.1.1")
    assert sessions.sensor_sessions(df, "y").count() == 0


def test_probe_and_score(spark):
    r = labels.attack_labels(spark.createDataFrame([(1, 0)], "unique_dest_ports int, cmd_count int")).first()
    assert [r[n] for n in LABELS] == [0] * 10 + [1] and r.attack_labels == "network_probe" and r.attack_label_count == 1
    s = labels.automation_profile(spark.createDataFrame([(0.9, 30.0, 1.0, 0)], "timing_variance_ratio double, events_per_minute double, cmd_unique_ratio double, burst_count int")).first()
    assert (s.automation_score, s.automation_likelihood) == (0.32, "mixed")


def test_pipes_split_only_where_asked(spark):
    df = spark.createDataFrame([(["cat x | sh"],)], "commands array<string>")
    assert features.command_features(df).first().cmd_count == 2 and features.command_features(df, split_pipes=False).first().cmd_count == 1


def test_network_expressions(spark):
    ips = {"": False, "0.0.0.0": False, "10.1.1.1": False, "192.168.0.1": False, "172.16.0.1": False, "172.33.0.1": False, "8.8.8.8": True, "110.1.1.1": True}
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    assert {r.ip: r.p for r in df.select("ip", net.is_public(F.col("ip")).alias("p")).collect()} == ips
    assert df.where(net.is_public(F.col("ip"), strict=True)).count() == 3


def test_clean_terminal_text(spark):
    row = spark.range(1).select(T.clean_input(F.lit(" lx\bs\x1b[0m \r\n")).alias("i"), T.clean_output(F.lit("a  \r\nb\rc \n\n")).alias("o")).first()
    assert (row.i, row.o) == ("ls", "a\nb\nc")


def test_inner_commands(spark):
    df = spark.createDataFrame([("A=$(cat $(ls x) | sort) $(id > f)",), (None,), ("plain",)], "command string")
    assert [r.inner for r in corpus.inner_commands(df).collect()][:1] == [["cat $(ls x)", "id"]]


def test_prompts(spark):
    df = spark.createDataFrame([("sys", "do", "done")], "s string, i string, o string")
    prompt = T.template(F.col("s"), F.col("i"))
    row = df.select(T.without_prompt(F.concat(prompt, F.lit("answer<|end|>")), prompt).alias("a"), T.template(F.col("s"), F.col("i"), F.col("o")).alias("t")).first()
    assert row.a == "answer" and row.t.endswith("done<|end|>")
    assert corpus.masked_text(spark.createDataFrame([("a", None), (None, "")], "instruction string, output string")).collect()[0].text == "a [SEP] "


def _numbers(spark, n=400):
    rows = [(k, float(k % 7), math.exp((k * 37 % 101) / 20), int(k % 7 > 4), int(k % 50 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, rare int")


def test_splits_and_folds(spark):
    df = mlprep.stratified_split(_numbers(spark), "y", "id")
    for y, n in Counter(r.y for r in df.collect()).items():
        parts = Counter(r.split for r in df.where(F.col("y") == y).collect())
        assert abs(parts["train"] - 0.7 * n) <= 1 and abs(parts["val"] - 0.15 * n) <= 1
    assert Counter(r.fold for r in mlprep.stratified_folds(_numbers(spark), "y", "id").collect()).keys() == set(range(5))


def test_scaler(spark):
    df = _numbers(spark)
    state = mlprep.fit_scaler(df, ["a", "b"], skew_over=0.5)
    assert {r.feature: r.log1p for r in state.collect()}["b"]
    r = mlprep.scale(df, state).agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.stddev_pop("b").alias("s")).first()
    assert r.a == pytest.approx(0, abs=1e-9) and r.b == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "a double")
    assert [r.a for r in mlprep.cleaned(odd, ["a"]).collect()] == [0.0, 0.0, 0.0, 2.0]


def test_leakage_gate(spark):
    df = _numbers(spark).withColumn("copy", F.col("y").cast("double"))
    assert mlprep.leaks(["a", "copy", "burst_count", "label_x"], ["y"], df) == ["burst_count", "copy", "label_x"]


def test_ranking_against_pairs(spark):
    rows = [(k * 17 % 11 % 2, (k * 29 % 13) / 13) for k in range(60)]
    r = metrics.ranking_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert r.roc_auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    one = metrics.ranking_metrics(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()
    assert one.roc_auc is None and one.average_precision is None


def test_models(spark):
    df = mlprep.stratified_split(_numbers(spark, 300), "y", "id")
    found = train.evaluate(df, ["a", "b"], ["y"], ["lr", "rf", "gbt"], rounds=5).collect()
    assert len(found) == 6 and all(r.f1 > 0.9 for r in found if r.model != "lr")
    assert metrics.best_model(spark.createDataFrame([("lr", 0.9), ("rf", 0.9)], "model string, f1 double"), ["lr", "rf"]).first().model == "lr"
    model = train.fit(df, ["a", "b"], "y", "rf", 5)
    assert train.importances(model, ["a", "b"], spark).first().feature == "a"
    assert train.eligible(df, ["y", "rare"]) == ["y"]
    attacks = train.predict_attacks({"y": model}, df, ["a", "b"])
    assert attacks.where("y = 1 and array_contains(attacks, 'y')").count() == df.where("y = 1").count()
    folds = train.cross_validate(df, ["a", "b"], "y", "id", "rf", folds=2, rounds=3).first()
    assert len(folds.per_fold) == 2 and folds.mean > 0.9


def test_isolation_forest(spark):
    rows = [(k, (k * 7919 % 1000) / 1000, (k * 104729 % 1000) / 1000, 0) for k in range(500)] + [(9000 + k, 8.0 + k, -9.0, 1) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    forest = anomaly.fit(df.where("label = 0"), ["x", "y"], "id", trees=20)
    scores = anomaly.score(df, forest, ["x", "y"])
    found = anomaly.flagged(scores.where("label = 0"), scores)
    rates = {r.label: r.flagged for r in metrics.anomaly_summary(found).collect()}
    assert rates[1] == 1.0 and rates[0] <= 0.02


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat sat down"), (2, "a b c d", "I'm sorry")], "k int, reference string, hypothesis string")
    assert [r.lcs for r in evaluation.longest_common(df).orderBy("k").collect()] == [3, 0]
    assert {r.k: r.matched for r in evaluation.overlap(df, "k", 2).collect()} == {1: 2, 2: 0}
    same = df.withColumn("hypothesis", F.col("reference"))
    assert evaluation.corpus_bleu(same, "k", 2).first().bleu == pytest.approx(1.0)
    rates = evaluation.quality_rates(df.withColumns({"c": F.lit("x"), "f1": F.lit(0.8)}), ["c"]).first()
    assert (rates.consistent, rates.leaked, rates.hallucinated) == (2, 1, 1)
    answers = evaluation.reference_answers(spark.createDataFrame([(" ls ", "one", 1), ("ls", "two", 2), ("", "x", 3)], "instruction string, output string, ord int"))
    assert [tuple(r) for r in answers.collect()] == [("ls", "two")]


def test_answers_and_export(spark, tmp_path):
    rows = spark.createDataFrame([_event(k, k * 10, request_data=f"cmd {k % 2}", username="u", password="p") for k in range(6)], SCHEMA).withColumn("session_id", F.lit("S%_1"))
    assert soc.session_list(rows, search="s%_").count() == 1 and soc.session_list(rows, search="sxx").count() == 0
    assert soc.timeline(rows, "S%_1", 3).count() == 3 and soc.health(rows).first().present
    assert soc.session_summary(rows, "S%_1").first().requests == 2
    full = session_intelligence(rows)
    nested = sinks.nested_sessions(full, ["cmd_entropy"]).first()
    assert nested.behaviours and nested.automation.automation_likelihood
    split = full.withColumn("split", F.lit("train"))
    sinks.save_splits(split, ["cmd_count"], ["bot_label"], str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/rows")).columns == ["cmd_count", "bot_label", "split"]
