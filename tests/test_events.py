"""Raw records to events: golden cases in the schemas of the three sensors."""

from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F

from sensorlens import schemas
from sensorlens.operators import normalize
from sensorlens.sources import readers, sinks, terminal
from sensorlens.streaming import events as streams

SSH = """{"eventid":"cowrie.session.connect","timestamp":"2025-12-01T10:00:00.000000Z","src_ip":"203.0.113.5","src_port":40001,"dst_port":22,"session":"s1"}
{"eventid":"cowrie.login.failed","timestamp":"2025-12-01T10:00:00.300000Z","src_ip":"203.0.113.5","session":"s1","username":"root","password":"root","message":"login attempt [root/root] failed"}
{"eventid":"cowrie.command.input","timestamp":"2025-12-01T10:00:06.000000Z","src_ip":"203.0.113.5","session":"s1","input":"uname -a"}
not json

["array, dropped"]
{"eventid":"cowrie.brand.new","timestamp":"bad","src_ip":"","src_host":"203.0.113.9","src_port":0,"peer_port":55}"""
SERVICE = """{"category":"heartbeat","type":"info","date":"2025-12-01T10:00:00Z"}
{"category":"http","type":"request","date":"2025-12-01T10:01:00Z","source-ip":"203.0.113.6","source-port":"5000","destination-port":"80","http.method":"GET","http.url":"/a","http.sessionid":"h1","http.header.user-agent":["UA/1","UA/2"]}
{"category":"ftp","date":"2025-12-01T10:02:00Z","source-ip":"203.0.113.7","ftp.sessionid":"f1","ftp.command":"USER anna "}"""
IDS = """{"event_type":"stats","timestamp":"2025-12-01T10:00:00.000000+0000"}
{"event_type":"alert","timestamp":"2025-12-01T10:03:00.000000+0000","src_ip":"203.0.113.8","src_port":1,"dest_ip":"198.51.100.2","dest_port":443,"proto":"TCP","flow_id":12,"http":{"hostname":"ex.test"},"alert":{"signature":"SCAN x","severity":2}}
{"event_type":"http","timestamp":"2025-12-01T10:04:00.000000+0000","src_ip":"203.0.113.8","http":"not an object"}"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def test_ssh(spark):
    rows = normalize.normalize_ssh(lines(spark, SSH), sensor_ip="198.51.100.1").collect()
    assert [r.event_type for r in rows] == ["ssh_connect", "ssh_login_failed", "ssh_command", "unknown"]
    assert rows[0].src_port == 40001 and rows[0].dest_port == 22 and rows[0].protocol == "ssh" and rows[0].dest_ip == "198.51.100.1"
    assert rows[1].request_data == "login attempt [root/root] failed" and rows[2].request_data == "uname -a"
    assert (rows[3].src_ip, rows[3].src_port, rows[3].timestamp) == ("203.0.113.9", 55, None)
    assert normalize.valid(normalize.normalize_ssh(lines(spark, SSH))).count() == 3
    assert normalize.quarantined(normalize.normalize_ssh(lines(spark, SSH))).first().missing_field == "timestamp"


def test_service(spark):
    http, ftp = normalize.normalize_service(lines(spark, SERVICE)).collect()
    assert (http.http_user_agent, http.src_port, http.dest_port, http.protocol, http.session_id, http.event_type) == ("UA/1", 5000, 80, "HTTP", "h1", "request")
    assert (ftp.username, ftp.event_type, ftp.request_data, ftp.protocol) == ("anna", "ftp", "USER anna ", "FTP")


def test_ids(spark):
    alert, http = normalize.normalize_ids(lines(spark, IDS)).collect()
    assert (alert.session_id, alert.http_uri, alert.alert_type, alert.severity) == ("12", "ex.test", "SCAN x", 2)
    assert alert.timestamp is not None and http.http_uri is None


def test_merge_and_own_form(spark):
    both = normalize.merged({"cowrie": lines(spark, SSH), "suricata": lines(spark, IDS)})
    assert both.count() == 6
    sent = both.select(F.to_json(F.struct("*")).alias("value")).unionByName(lines(spark, "broken{\n[1]"))
    assert readers.decoded(sent).select("src_ip", "event_type").exceptAll(both.select("src_ip", "event_type")).count() == 0
    assert readers.decoded(sent).count() == 6


def test_nested_paths(spark):
    rows = spark.createDataFrame([('{"a.b": 1, "a": {"b": 2}}',), ('{"a": {"b": 2}}',)], "raw string").withColumn("_v", F.try_parse_json("raw"))
    assert [r[0] for r in rows.select(normalize.nested("a.b")).collect()] == ["1", "2"]


def _recording(*records):
    return b"".join(struct.pack("<IIIIII", op, 0, len(p), d, 1, 2) + p for op, d, p in records)


def test_terminal(spark):
    out, into = terminal.OUTPUT, terminal.INPUT
    raw = _recording((1, 0, b""), (3, out, b"banner"), (3, into, b"ls"), (3, into, b"\r"), (3, out, b"a\r\n"), (3, out, b"b"), (3, into, b"id\r"), (3, out, b"\x1b[31mroot\x1b[0m  \n")) + b"\3\0\0\0cut"
    df = spark.createDataFrame([("one", bytearray(raw)), ("two", bytearray(b"short")), ("three", bytearray(_recording((9, out, b"x"))))], "path string, content binary")
    assert [(r.instruction, r.output) for r in terminal.pairs(df).orderBy("pair").collect()] == [("ls", "a\nb"), ("id", "root")]
    assert terminal.records(df).count() == 8


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(SSH)
    source = readers.sensor_stream(spark, str(tmp_path / "in"), "cowrie")
    for _ in range(2):  # nothing is there the second time
        streams.ingest(source, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/table")).count() == 3
    assert spark.read.json(str(tmp_path / "out/quarantine")).first().missing_field == "timestamp"
    assert spark.read.schema(schemas.EVENT).json(str(tmp_path / "out/backup")).count() == 3


def test_stream_sessions_are_the_batch_ones(spark, tmp_path):
    from sensorlens.operators import sessions

    rows = [(k, f"a{k % 3}", "d", f"2025-01-01 {h:02d}:{m:02d}:00") for k, (h, m) in enumerate((h, m) for h in range(6) for m in (0, 20, 55))]
    late = [(99, "z", "d", "2025-01-03 00:00:00")]
    make = lambda r: spark.createDataFrame(r, "id long, src_ip string, dest_ip string, t string").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    batch = sessions.session_bounds(sessions.sessionize(make(rows)))
    make(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    make(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(make(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.gap_sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("src_ip <> 'z'").select("src_ip", "start_time", "end_time", "event_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("src_ip", "start_time", "end_time", "event_count").collect()))


def test_sinks(spark, tmp_path):
    events = normalize.valid(normalize.normalize_ssh(lines(spark, SSH)))
    sinks.append_events(events, str(tmp_path / "t"))
    sinks.append_events(events, str(tmp_path / "t"))
    assert readers.event_table(spark, str(tmp_path / "t")).count() == 6
    sinks.json_lines(spark.createDataFrame([("a", "b")], schemas.CORPUS), str(tmp_path / "c"))
    (tmp_path / "d.jsonl").write_text('{"instruction": "x", "output": "y"}\n\nbroken\n')
    assert readers.json_lines(spark, str(tmp_path / "c")).first().output == "b" and readers.json_lines(spark, str(tmp_path / "d.jsonl")).count() == 1
    sinks.report(spark.createDataFrame([(1, 0.5)], "a int, b double"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"a": 1, "b": 0.5}


def test_exports_and_results(spark, tmp_path):
    (tmp_path / "e.csv").write_text('source_cowrie,event_type,session_id,session_duration,request_data,raw\n1,cmd,s,2.5,"echo ""a""\nb","{}"\n')
    row = readers.flat_export(spark, str(tmp_path / "e.csv")).first()
    assert row.request_data == 'echo "a"\nb' and row.session_duration == 2.5
    (tmp_path / "g.json").write_text('[{"query": "1.1.1.1", "country": "X", "lat": 1.0, "lon": 2.0, "org": "Big Cloud", "count": 0}]')
    assert readers.geo_records(spark, str(tmp_path / "g.json")).first().country == "X"
    (tmp_path / "p.json").write_text(json.dumps({"engagement": {"0.2": {"mean": 1.0}}}))
    (tmp_path / "f.json").write_text(json.dumps({"engagement": {"0.2": {"mean": 9.0, "max": 3.0}}}))
    got = {(r.factor, r.metric): r.value for r in readers.evaluation_results(spark, str(tmp_path / "p.json"), str(tmp_path / "f.json")).collect()}
    assert got == {("0.2", "mean"): 1.0, ("0.2", "max"): 3.0}
