"""Readers that follow growing files and cut quoted ones, and streams that keep sessions in their state."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sensorlens.operators import sessions
from sensorlens.plans.streams import run, state_store
from sensorlens.sources import exports, growing, readers
from sensorlens.streaming import events as streams, sessions as live

SCHEMA = "source_cowrie int, event_type string, session_id string, session_duration double, request_data string, raw string"


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "50"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def made_export(rows, feed="\n", seed=1):
    draw = random.Random(seed)
    texts = ["plain", 'say ""hi""', "a, b", "", "one\ntwo", "\n\n", 'x\n""\n', "é\nü" * 40, '"",\n""', "long " * 400 + "\n" + "end " * 300, "\r\nz", "l\n" * 1500]
    out = ["source_cowrie,event_type,session_id,session_duration,\"request\ndata\",raw"]
    for k in range(rows):
        text = draw.choice(texts)
        field = f'"{text}"' if text or k % 2 else ""
        out.append(f'{k % 2},cmd,s{k},{k}.5,{field},"{{}}"' + ("" if k % 7 else f"{feed}{feed}".rstrip("\r\n")))
    return feed.join(out)


@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_quoted_exports_in_ranges(spark, tmp_path, small_ranges, feed):
    for k, n in enumerate((400, 1, 0)):
        (tmp_path / f"e{k}.csv").write_bytes((made_export(n, feed, k) + feed * (k == 0)).encode())
    lines = exports.lines(spark, str(tmp_path))
    assert lines.select("path", "at").distinct().count() > 50
    want = spark.read.csv(str(tmp_path), schema=SCHEMA, header=True, multiLine=True, escape='"')
    got = exports.quoted_csv(spark, str(tmp_path), SCHEMA)
    assert got.columns == want.columns
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(got) == key(want) and got.count() == 401
    assert exports.ranges(lines).where("inside").count() > 5
    kinds = {r.kind for r in exports.pieces(lines).select("kind").distinct().collect()}
    assert kinds == {exports.WHOLE, exports.HEAD, exports.TAIL, exports.THROUGH}
    assert key(readers.flat_export(spark, str(tmp_path))) == key(want)


def test_export_that_no_quote_ends(spark, tmp_path):
    (tmp_path / "e.csv").write_text('h,e,s,d,q,r\n1,a,s,1.0,"x\ny\n')
    assert [r.request_data for r in exports.quoted_csv(spark, str(tmp_path), SCHEMA).collect()] == ["x\ny\n"] or exports.records(spark, str(tmp_path)).count() == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/e.csv").write_text("")
    assert exports.quoted_csv(spark, str(tmp_path / "empty"), SCHEMA).collect() == []


def _lines(spark, out):
    return sorted(r.value for r in spark.read.text(f"{out}/rows").collect()) if os.path.exists(f"{out}/rows") else []


def _follow(stream, out):
    stream.select("value").writeStream.format("text").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def test_growing_log(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    start = lambda: growing.growing_lines(spark, str(log / "s.json*"), start="end", rangeBytes=64)  # noqa: E731  a new start each time
    (log / "s.json").write_text("old 1\nold 2\nhalf")
    _follow(start(), out)
    assert _lines(spark, out) == []
    with open(log / "s.json", "a") as f:
        f.write(" line\nnew 1\r\n\nnew 2 without an end")
    _follow(start(), out)
    assert _lines(spark, out) == ["", "half line", "new 1"]
    with open(log / "s.json", "a") as f:
        f.write(" yet\n" + "".join(f"row {k} {'x' * (k % 50)}\n" for k in range(200)))
    os.rename(log / "s.json", log / "s.json.1")  # rotated with lines not read yet
    (log / "s.json").write_text("first of the next\nand")
    _follow(start(), out)
    want = ["", "half line", "new 1", "new 2 without an end yet", "first of the next", *(f"row {k} {'x' * (k % 50)}" for k in range(200))]
    assert _lines(spark, out) == sorted(want)
    with open(log / "s.json", "a") as f:
        f.write(" more\nlast\n")
    _follow(start(), out)
    _follow(start(), out)
    assert _lines(spark, out) == sorted([*want, "and more", "last"])


def test_growing_log_in_bounded_batches(tmp_path):
    text = "".join(f"{k:04d}{'y' * (k % 9)}\n" for k in range(300)) + "z" * 500 + "\nend\nhalf"
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("b 1\nb 2\n")
    reader = growing.GrowingReader(str(tmp_path / "*.log"), "beginning", 37, 256)
    at, read = reader.initialOffset(), []
    for _ in range(100):
        to = json.loads(json.dumps(reader.latestOffset()))
        parts = reader.partitions(at, to)
        if not parts:
            break
        batch = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert sum(len(v) + 1 for v in batch) <= 256 or len(batch) == 1
        read += batch
        at = to
    assert sorted(read) == sorted([*text.split("\n")[:-1], "b 1", "b 2"])
    # Read again from any offset: each line is in one range.
    whole = [v for p in reader.partitions({"files": {}}, at) for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert sorted(whole) == sorted(read)


def test_growing_sensor_stream(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"eventid":"cowrie.command.input","timestamp":"2025-12-01T10:00:06.000000Z","src_ip":"203.0.113.5","session":"s1","input":"id"}\nnot json\n')
    query = readers.growing_sensor_stream(spark, str(tmp_path / "s.json"), "cowrie", start="beginning").writeStream.format("memory").queryName("growing_events").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.event_type, r.request_data) for r in spark.table("growing_events").collect()] == [("ssh_command", "id")]


def test_session_features_of_a_stream(spark, tmp_path):
    """Events in another order within the watermark, ties, null keys, and events too late."""
    draw = random.Random(4)
    made, at = [], 1_700_000_000_000_000
    for k in range(400):
        at += draw.choice([100_000, 400_000, 0, 6_000_000, 61_000_123, 1_900_000_000])
        made.append((k, draw.choice(["a", "b", None]), "d", at))
    schema = "id long, src_ip string, dest_ip string, us long"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    marked = sessions.sessionize(frame(made))
    batch = sessions.session_bounds(marked).join(sessions.delay_statistics(marked), "session")
    for k in range(0, 400, 100):
        part = made[k : k + 100]
        for i in range(0, len(part) - 1, 2):  # neighbours within the watermark change places
            if part[i + 1][3] - part[i][3] < 500_000_000:
                part[i], part[i + 1] = part[i + 1], part[i]
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame([(900, "a", "d", 1_600_000_000_000_000), (901, "end", "d", at + 86_400_000_000)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(made).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with state_store(spark):
        query = live.session_features(stream).writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "rows")).where("src_ip is null or src_ip <> 'end'")
    columns = ["session", "start_time", "end_time", "event_count", "duration_sec", "min_inter_cmd_delay", "max_inter_cmd_delay", "burst_count"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns, F.round("avg_inter_cmd_delay", 6), F.round("std_inter_cmd_delay", 6)).collect())
    assert key(got) == key(batch) and got.count() > 20
    assert got.agg(F.sum("reordered")).first()[0] > 20 and live.late_events(query) == 1


def test_streams_without_repeats_and_by_day(spark, tmp_path):
    rows = [("cowrie", "s", "2025-01-01 10:00:00", "x"), ("cowrie", "s", "2025-01-01 10:00:00", "x"), ("cowrie", "s", "2025-01-01 10:00:00", "y"), ("cowrie", "s", "2025-01-02 10:00:00", "x"), ("end", "e", "2025-02-01 00:00:00", "z")]
    df = spark.createDataFrame(rows, "log_source string, session_id string, t string, raw string").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(streams.without_repeats(stream), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once/rows")).count() == 4
    run(streams.daily_counts(stream), str(tmp_path / "days"))
    assert [(str(r.day), r.cnt) for r in spark.read.parquet(str(tmp_path / "days/rows")).orderBy("day").collect()] == [("2025-01-01", 3), ("2025-01-02", 1)]
