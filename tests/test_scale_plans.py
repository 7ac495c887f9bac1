"""Plans in two levels give what one window would, and small operators what they say."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from sensorlens.functions import text as T
from sensorlens.operators import anomaly, corpus, evaluation, mlprep, ranks, sessions, soc, train


def test_sessions_over_days_are_those_of_one_pass(spark):
    draw, start = random.Random(4), dt.datetime(2024, 1, 1, 20)
    rows = []
    for k in range(400):
        at = start + dt.timedelta(seconds=draw.choice([0, 1, 60, 1800, 1801, 3600, 40_000, 90_000]) * draw.randint(0, 9), milliseconds=draw.randint(0, 2) * 300)
        rows.append((k, draw.choice(["a", "b", None]), "x", None if k % 50 == 7 else at))
    df = spark.createDataFrame(rows, "id long, src_ip string, dest_ip string, timestamp timestamp_ntz").repartition(3)
    got = {r.id: (r.session, r.delay, r.next_delay) for r in sessions.sessionize(df).collect()}
    want, number, last = {}, {}, {}
    for i, src, _, at in sorted((r for r in rows if r[3]), key=lambda r: (str(r[1]), r[3], r[0])):
        gap = (at - last[src][1]) / dt.timedelta(microseconds=1) if src in last else None
        new = gap is None or gap > 1800e6
        number[src] = number.get(src, 0) + new
        delay = None if new else gap // 1000 / 1000
        if not new:
            want[last[src][0]] = (*want[last[src][0]][:2], delay)
        want[i] = ("::".join(x for x in (src, "x", f"s{number[src]}") if x), delay, None)
        last[src] = (i, at)
    assert got == want


@pytest.mark.parametrize("down", [False, True])
def test_running_sums(spark, down):
    draw = random.Random(3)
    rows = [(k, draw.choice(["u", "v", None]), draw.choice([0.0, 1.5, draw.random(), -7.0, 100.0]), draw.randint(0, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x double, n long").repartition(4)
    order = [ranks.F.col("x").desc() if down else ranks.F.col("x"), ranks.F.col("id")]
    got = {r.id: (r.place, r.total, r.all_place, r.all_total) for r in ranks.running(df, ["g"], ranks.by_size(df, "x", 16), order, {"place": None, "total": "n"}, down=down).collect()}
    for g in ("u", "v", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2] if down else r[2], r[0]))
        total = 0
        for place, r in enumerate(own, 1):
            total += r[3]
            assert got[r[0]] == (place, total, len(own), sum(q[3] for q in own))


def test_running_sums_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double")
    assert sorted(r.place for r in ranks.running(one, [], ranks.by_size(one, "x"), [ranks.F.col("id")], {"place": None}).collect()) == [1, 2]
    none = one.limit(0)
    assert ranks.running(none, [], ranks.by_size(none, "x"), [ranks.F.col("id")], {"place": None}).count() == 0


def test_entropies(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"], "aab"), ([], ""), (None, None), (["x"], "日本日本")], "l array<string>, t string")
    got = [tuple(r) for r in rows.select(T.list_entropy(ranks.F.col("l")), T.char_entropy(ranks.F.col("t"))).collect()]
    assert got == [(1.5, pytest.approx(0.9182958)), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_longer_grams(spark):
    rows = spark.createDataFrame([(1, "a b a b c", "a b c"), (2, "a", "a b"), (3, None, "x y")], "k long, reference string, hypothesis string")
    got = {r.k: (r.matched, r.in_reference, r.in_hypothesis) for r in evaluation.overlap(rows, "k", 2).collect()}
    assert got == {1: (2, 4, 2), 2: (0, 0, 1), 3: (0, 0, 1)}


def test_forest_of_a_large_table_draws_a_row_for_one_tree_at_most(spark):
    df = spark.range(60_000).selectExpr("id", "cast(id % 100 as double) as a", "cast(id % 7 as double) as b")
    forest = anomaly.fit(df, ["a", "b"], "id", trees=20, sample=256)
    sizes = [r["count"] for r in forest.groupBy("tree").count().collect()]
    assert len(sizes) == 20 and min(sizes) > 100
    odd = spark.createDataFrame([(0, 50.0, 3.0), (1, 5000.0, 90.0)], "id long, a double, b double")
    low, high = (r.score for r in anomaly.score(odd, forest, ["a", "b"]).orderBy("id").collect())
    assert low < high
    assert anomaly.rare(df.selectExpr("cast(id < 49 as int) as y"), "y") and not anomaly.rare(df.selectExpr("cast(id < 50 as int) as y"), "y")


def test_scaler_can_be_kept(spark, tmp_path):
    rows = spark.range(50).selectExpr("cast(id as double) as a", "cast(id * id * id as double) as b")
    scaler = mlprep.fit_scaler(rows, ["a", "b"], skew_over=0.5)
    mlprep.save_scaler(scaler, f"file://{tmp_path}/scaler")
    again = mlprep.load_scaler(spark, f"file://{tmp_path}/scaler")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scaler.collect()))
    assert mlprep.scale(rows, again).collect() == mlprep.scale(rows, scaler).collect()


def test_page_of_a_session_is_limited(spark):
    rows = [(k, "s", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), "ssh_command", f"u{k:03}", "p", f"cmd {k}") for k in range(700)] + [(999, "t", None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "id long, session_id string, timestamp timestamp_ntz, event_type string, username string, password string, request_data string")
    df = df.selectExpr("*", "'c' log_source", "'1' src_ip", "'2' dest_ip", "22 dest_port", "'' http_uri", "'ssh' protocol")
    page = soc.session_answer(df, "s")
    assert {k: v.count() for k, v in page.items()} == {"summary": 1, "timeline": 500, "credentials": 50, "commands": 100}
    assert set(page["timeline"].columns) <= set(soc.TIMELINE_COLUMNS) and len(soc.TIMELINE_COLUMNS) == 18 and len(soc.LOG_COLUMNS) == 12
    assert soc.latest_in_time(df).first().id == 699


def test_means_and_sizes(spark):
    each = spark.createDataFrame([("a", 0.5), ("a", 0.3), ("b", 0.9)], "feature string, importance double")
    assert {r.feature: r.importance for r in train.mean_importances(each, 3).collect()} == {"a": pytest.approx(0.8 / 3), "b": pytest.approx(0.3)}
    rows = spark.createDataFrame([("x", "1"), (" x ", "2"), ("", "3"), ("y", ""), (None, "z")], "instruction string, output string")
    assert tuple(corpus.sizes({"n": rows}).first()) == ("n", 5, 3, 1)
    geo = spark.createDataFrame([("203.0.113.7",), (None,), ("198.51.100.1",)], "query string")
    assert soc.places(geo, "113").count() == 1 and soc.places(geo).count() == 3
