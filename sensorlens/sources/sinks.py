"""Writers of events, sessions, splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import normalize


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to the table, by day, so that scans of a time range read its days alone."""
    events.withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").parquet(path)


def backup(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def publish(events: DataFrame, servers: str, topic: str, checkpoint: str, **options):
    """Sends events of a stream to a broker, as JSON."""
    message = events.select(F.to_json(F.struct("*")).alias("value"))
    return message.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, **options}).start()


def ingest_batch(folder: str):
    """For ``foreachBatch``: valid events to the table and the backup, others to quarantine, each batch once.

    A batch that is run again overwrites its own files, found by its number.
    """

    def write(events: DataFrame, batch: int) -> None:
        events = events.persist()
        good = normalize.valid(events).withColumn("event_date", F.to_date("timestamp"))
        good.write.mode("overwrite").partitionBy("event_date").parquet(f"{folder}/table/batch={batch}")
        good.drop("event_date").write.mode("overwrite").json(f"{folder}/backup/batch={batch}")
        normalize.quarantined(events).write.mode("overwrite").json(f"{folder}/quarantine/batch={batch}")
        events.unpersist()

    return write


def nested_sessions(sessions: DataFrame, features: list[str], most: int = 5000, places: int = 2) -> DataFrame:
    """The first ``most`` sessions as nested records: behaviours as a list, automation and features as objects."""
    rounded = lambda c: F.round(F.col(c).cast("double"), places).alias(c)
    behaviours = F.filter(F.split("attack_labels", r"[|]"), lambda x: x != "")
    automation = F.struct(rounded("automation_score"), "automation_likelihood")
    return sessions.select("session", "src_ip", "dest_ip", behaviours.alias("behaviours"), automation.alias("automation"), F.struct(*map(rounded, features)).alias("features")).orderBy("session").limit(most)


def save_splits(df: DataFrame, features: list[str], labels: list[str], folder: str) -> None:
    """Rows by ``split``, and the lists of columns beside them."""
    df.select("split", *features, *labels).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/rows")
    spark = df.sparkSession
    for name, columns in (("feature_columns", features), ("label_columns", labels)):
        spark.createDataFrame([(columns,)], "columns array<string>").select(F.to_json("columns").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def report(metrics: DataFrame, path: str) -> None:
    metrics.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
