"""Queries that run streams and readers over what Spark makes of the driver's tables. None of them can be right if its stream gives nothing."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import exports, growing
from ..sources.shared import new_place as folder
from ..streaming import events as streams, sessions as live
from .registry import _t, _time, query

GAP = 7200


def run(stream: DataFrame, out: str) -> None:
    """Writes what a stream has to give now."""
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def replayed(spark: SparkSession, sf_dir: str, out: str, work) -> DataFrame:
    """The rows that ``work`` makes of the events as a stream, ended by an event far ahead, with which the watermark closes all.

    ``work`` gets ``event_id, user_id, ts``; the last event has ``user_id`` -1.
    """
    path = f"{sf_dir}/events.parquet"
    columns = ["event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")]
    given = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(*columns)
    end = spark.read.parquet(path).agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end.limit(0).write.parquet(f"{out}/end")
    stream = work(given.unionByName(spark.readStream.schema(end.schema).parquet(f"{out}/end")))
    run(stream, out)
    end.write.mode("append").parquet(f"{out}/end")
    run(stream, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keeps list state and timers, for the streams that start inside."""
    name, provider = live.STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


SESSIONS_SQL = f"""WITH g AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > {GAP * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g),
d AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(before) <= {GAP * 1_000_000} THEN floor((epoch_us(ts) - epoch_us(before)) / 1000) / 1000.0 END AS delay FROM m),
b AS (SELECT *, lead(delay) OVER (PARTITION BY user_id, n ORDER BY ts, event_id) AS next FROM d)
"""


@query(SESSIONS_SQL + "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_time, count(*) AS event_count FROM m GROUP BY user_id, n", log=False)
def stream_sessions(spark, sf_dir):
    """Gap sessions of the event files as a stream, all of them closed by its watermark."""
    work = lambda events: streams.gap_sessions(events, keys=("user_id",), ts="ts", gap="2 hours")
    return replayed(spark, sf_dir, folder(spark, "stream"), work).where("user_id >= 0").select("user_id", _time("start_time"), _time("end_time"), "event_count")


@query(SESSIONS_SQL + """SELECT user_id, user_id || '::s' || n AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_time, count(*) AS event_count,
round(coalesce(avg(delay), 0), 5) AS avg_inter_cmd_delay, round(coalesce(stddev_pop(delay), 0), 5) AS std_inter_cmd_delay, coalesce(min(delay), 0) AS min_inter_cmd_delay, coalesce(max(delay), 0) AS max_inter_cmd_delay,
count(*) FILTER (delay < 0.5 AND next > 5.0) AS burst_count FROM b GROUP BY user_id, n""", log=False)  # fmt: skip
def stream_session_features(spark, sf_dir):
    """Sessions with their delays from a stream's state alone."""
    work = lambda events: live.session_features(events, keys=("user_id",), ts="ts", gap_seconds=GAP)
    with state_store(spark):
        found = replayed(spark, sf_dir, folder(spark, "features"), work)
    rounded = [F.round(c, 5).alias(c) for c in ("avg_inter_cmd_delay", "std_inter_cmd_delay")]
    return found.where("user_id >= 0").select("user_id", "session", _time("start_time"), _time("end_time"), "event_count", *rounded, "min_inter_cmd_delay", "max_inter_cmd_delay", "burst_count")


@query("SELECT event_id, 1::BIGINT AS n FROM events", log=False)
def stream_without_repeats(spark, sf_dir):
    """Each event given twice to a stream comes out once."""

    def work(events):
        twice = events.withColumns({"log_source": F.lit("cowrie"), "session_id": F.col("user_id").cast("string"), "raw": F.col("event_id").cast("string"), "timestamp": F.col("ts")})
        twice = twice.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
        return streams.without_repeats(twice).select("event_id", "user_id")

    return replayed(spark, sf_dir, folder(spark, "once"), work).where("user_id >= 0").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt FROM events GROUP BY 1", log=False)
def stream_daily_counts(spark, sf_dir):
    work = lambda events: streams.daily_counts(events, ts="ts")
    found = replayed(spark, sf_dir, folder(spark, "daily"), work)
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.to_date(F.max("ts")).alias("last"))
    return found.join(F.broadcast(last), F.col("day") <= F.col("last")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cnt")  # one row


@query("SELECT event_id, event_type, 1::BIGINT AS n FROM events", log=False)
def growing_log(spark, sf_dir):
    """Events written to a log and read from it while it grows, over two starts of one stream: each line once."""
    out = folder(spark, "log")
    lines = _t(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "props")).alias("value"))
    stream = growing.growing_lines(spark, f"{out}/log/part-*", start="beginning", rangeBytes=1 << 20)
    for half in (0, 1):
        lines.where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(f"{out}/log")
        run(stream, out)
    read = spark.read.schema(stream.schema).parquet(f"{out}/rows").select(F.from_json("value", "event_id long, event_type string").alias("e")).select("e.*")
    return read.groupBy("event_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id::VARCHAR AS session_id, event_type, (event_id % 2)::INT AS source_cowrie, CASE WHEN event_id % 3 = 0 THEN 'line ' || event_id || chr(10) || '"' || event_type || '",' || chr(10) || chr(10) || 'end'
WHEN event_id % 3 = 1 THEN 'one, line' END AS request_data, value AS session_duration FROM events""", log=False)
def quoted_export(spark, sf_dir):
    """An export of the events with line feeds, commas and quotes inside its fields, written and read back by ranges."""
    out = folder(spark, "export")
    i, feed = F.col("event_id"), F.lit("\n")
    text = F.when(i % 3 == 0, F.concat(F.lit("line "), i.cast("string"), feed, F.lit('"'), F.col("event_type"), F.lit('",'), feed, feed, F.lit("end"))).when(i % 3 == 1, "one, line")
    rows = _t(spark, sf_dir, "events").select((i % 2).cast("int").alias("source_cowrie"), "event_type", i.cast("string").alias("session_id"), F.col("value").alias("session_duration"), text.alias("request_data"), F.lit(None).cast("string").alias("raw"))
    rows.write.csv(out, header=True, escape='"', quote='"')
    read = exports.quoted_csv(spark, out, "source_cowrie int, event_type string, session_id string, session_duration double, request_data string, raw string")
    return read.select("session_id", "event_type", "source_cowrie", "request_data", "session_duration")
