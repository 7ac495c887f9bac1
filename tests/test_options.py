"""Options that leave a published figure's way of counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlens.operators import features, normalize, sessions


def test_flags_by_command(spark):
    df = spark.createDataFrame([(["tar x", "ls"], 0), (["tar c | nc h", "ls"], 1), (["wget u", "chmod x"], 2), (["wget u; chmod x"], 3), ([], 4)], "commands array<string>, k int")
    got = lambda **o: {r.k: (r.has_file_exfiltration, r.has_download_execute_chain) for r in features.command_features(df, **o).collect()}
    assert got() == {0: (1, 0), 1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0)}
    assert got(per_command=True) == {0: (0, 0), 1: (1, 0), 2: (0, 0), 3: (0, 1), 4: (0, 0)}


def test_ids_without_the_sensors_name(spark):
    raw = spark.createDataFrame([(f'{{"eventid": "{e}"}}',) for e in ("cowrie.login.failed", "cowrie.new.thing", "other", "cowrie.")] + [("{}",)], "value string")
    assert [r.event_type for r in normalize.normalize_ssh(raw).collect()] == ["ssh_login_failed", *["unknown"] * 4]
    assert [r.event_type for r in normalize.normalize_ssh(raw, strip_prefix=True).collect()] == ["ssh_login_failed", "new.thing", "other", "unknown", "unknown"]


def test_login_events_are_counted(spark):
    rows = [(k, "a", "b", kind, f"2025-01-01 10:00:{k:02d}") for k, kind in enumerate(["ssh_connect", "ssh_login_failed", "ssh_login_failed", "ssh_command", None])]
    df = spark.createDataFrame(rows, "id long, src_ip string, dest_ip string, event_type string, t string").withColumn("timestamp", F.to_timestamp("t"))
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("request_data", "log_source")})
    row = features.session_features(sessions.build_sessions(df)).first()
    assert (row.login_event_count, row.credential_attempts, row.event_count) == (3, 2, 5)
