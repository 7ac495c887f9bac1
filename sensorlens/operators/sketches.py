"""Distinct counts that add up: HyperLogLog sketches by day and source, of which any range of days is a union.

With 2 ** 14 registers the standard error is 0.65 %; ``distinct_over`` gives the count, ``soc.sessions_per_source`` the exact one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTERS = 14
#: Three standard errors of the estimate.
ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2) * 0.8


def daily_sketches(events: DataFrame, columns: tuple[str, ...] = ("session_id", "src_ip"), key: str = "log_source") -> DataFrame:
    """``day``, ``key``, ``events`` and a sketch of the non-empty values of each of ``columns``; a row for each day and key.

    Events without a time are left out; a day on which a column has no value has an empty sketch.
    """
    some = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    rows = events.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day"), key)
    return rows.agg(F.count("*").alias("events"), *(F.hll_sketch_agg(some(c), REGISTERS).alias(c) for c in columns))


def put_days(sketches: DataFrame, path: str) -> None:
    """Writes the days of ``sketches``; a day that is there already is replaced, and no other is read or written."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def distinct_over(sketches: DataFrame, first: str | None = None, last: str | None = None, columns: tuple[str, ...] = ("session_id", "src_ip"), keys: tuple[str, ...] = ("log_source",)) -> DataFrame:
    """``keys``, ``events`` and about how many different values of each of ``columns`` there are from day ``first`` to ``last``."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return rows.groupBy(*keys).agg(F.sum("events").alias("events"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns))


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
