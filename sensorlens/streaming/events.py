"""Streams of events: ingest, gap sessions and daily counts, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import ingest_batch


def ingest(events: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes a stream of events to ``folder`` by ``ingest_batch``; ``once``: what is there now, then ends."""
    writer = events.writeStream.foreachBatch(ingest_batch(folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_repeats(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events of which one with the same source, session, time and raw text came within the watermark are left out."""
    keyed = events.withColumn("_hash", F.xxhash64("raw")).withWatermark("timestamp", delay)
    return keyed.dropDuplicatesWithinWatermark(["log_source", "session_id", "timestamp", "_hash"]).drop("_hash")


def gap_sessions(events: DataFrame, keys=("src_ip", "dest_ip"), ts: str = "timestamp", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed sessions with bounds and counts; the end is the last event's time."""
    session = F.session_window(ts, gap)
    grouped = events.withWatermark(ts, delay).groupBy(*keys, session.alias("w")).agg(F.count("*").alias("event_count"), F.max(ts).alias("end_time"))
    return grouped.select(*keys, F.col("w.start").alias("start_time"), "end_time", "event_count")


def daily_counts(events: DataFrame, ts: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("cnt"))
    return grouped.select(F.to_date("w.start").alias("day"), "cnt")
