"""Readers of sensor logs, exports, corpora and places. Batch and streaming forms take the same options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators import normalize
from . import exports, growing


def sensor_log(spark: SparkSession, path: str, log_source: str) -> DataFrame:
    """Normalised events of a log with one JSON object a line; other lines give none."""
    return normalize.NORMALIZERS[log_source](spark.read.text(path))


def growing_sensor_stream(spark: SparkSession, path: str, log_source: str, start: str = "end", **options) -> DataFrame:
    """Normalised events of the lines appended to logs at ``path``, from their end or their beginning on, over rotations."""
    return normalize.NORMALIZERS[log_source](growing.growing_lines(spark, path, start, **options))


def sensor_stream(spark: SparkSession, path: str, log_source: str, files_per_trigger: int = 100) -> DataFrame:
    """Normalised events of log files that come whole and don't grow."""
    return normalize.NORMALIZERS[log_source](spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def broker_stream(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 100_000, **options) -> DataFrame:
    """Normalised events that another process published as JSON. Secrets go in ``options``, never in code."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": offsets_per_trigger, **options}).load()
    return decoded(raw.select(F.col("value").cast("string").alias("value")))


def decoded(raw: DataFrame, text: str = "value") -> DataFrame:
    """Events from their own JSON form; text that is none gives no row."""
    parsed = raw.select(F.from_json(text, schemas.EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json(text).alias("v"))
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT")).select("e.*")


def event_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def event_database(spark: SparkSession, url: str, table: str, key: str = "id", parts: int = 16, bounds: tuple[int, int] | None = None, **options) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of ``key`` from its least to its greatest, with its text columns typed."""
    if bounds is None:
        ends = spark.read.jdbc(url, f"(SELECT min({key}) AS low, max({key}) AS high FROM {table}) ends", properties=options).first()
        low, high = (0 if x is None else int(x) for x in ends)
        bounds = (low, max(high + 1, low + parts))
    raw = spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)
    return normalize.typed(raw)


def flat_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exports; a file of any size is read by as many tasks as it has ranges, whatever line feeds its fields hold."""
    return exports.quoted_csv(spark, path, schemas.FLAT_EXPORT)


def json_lines(spark: SparkSession, path: str, schema: str = schemas.CORPUS) -> DataFrame:
    """Rows of a JSONL file; blank lines and lines that are no JSON are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def geo_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GEO).json(path, multiLine=True)


def evaluation_results(spark: SparkSession, preferred: str, fallback: str | None = None) -> DataFrame:
    """``factor, metric, value`` of result documents, each a map of factors to maps of metrics.

    Where a factor is in both, the preferred document counts.
    """

    def long(path: str, rank: int) -> DataFrame:
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "engagement map<string, map<string, double>>").alias("d"))
        factors = doc.select(F.explode("d.engagement").alias("factor", "metrics"))
        return factors.select("factor", F.explode("metrics").alias("metric", "value"), F.lit(rank).alias("rank"))

    rows = long(preferred, 0)
    if fallback:
        rows = rows.unionByName(long(fallback, 1))
    return rows.groupBy("factor", "metric").agg(F.min_by("value", "rank").alias("value"))


def terminal_recordings(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the recordings in a directory that can hold a record."""
    return spark.read.format("binaryFile").load(path).where("length >= 24").select("path", "content")
