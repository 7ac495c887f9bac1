"""Ranks and running sums in two levels: inside buckets of the order, and over one row for each bucket.

No window holds more than a bucket, so a label or a whole table is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quantiles import balanced_buckets

BUCKETS = 1024


def by_size(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """A bucket for each value of a number, rising with it, of about as many rows each, whatever their spread."""
    return balanced_buckets(df, column, buckets)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, str | None], down: bool = False) -> DataFrame:
    """``df`` with, for each ``new: old`` of ``sums``, the sum of ``old`` (None: the number of rows) over the rows of ``keys`` up
    to and with this one in ``order``. ``bucket`` must rise with the order, or fall if ``down``. ``new`` over all: ``all_new``.
    """
    # A struct is never null, so that null keys are a key: windows and the join have one partitioning of the rows.
    rows = df.withColumns({"_bucket": bucket, "_key": F.struct(*keys) if keys else F.struct(F.lit(0))})
    value = {new: F.lit(1) if old is None else F.col(old) for new, old in sums.items()}
    totals = rows.groupBy("_key", "_bucket").agg(*(F.sum(v).alias(f"_sum_{new}") for new, v in value.items()))
    at = F.col("_bucket").desc() if down else F.col("_bucket")
    before = W.partitionBy("_key").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("_key")
    places = totals.select(F.col("_key").alias("_at_key"), F.col("_bucket").alias("_at_bucket"), *(F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_before_{new}") for new in sums), *(F.sum(f"_sum_{new}").over(every).alias(f"all_{new}") for new in sums))
    inside = W.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({f"_in_{new}": F.sum(v).over(inside) for new, v in value.items()})
    out = summed.join(places, (F.col("_key") == F.col("_at_key")) & (F.col("_bucket") == F.col("_at_bucket")))
    return out.withColumns({new: F.col(f"_before_{new}") + F.col(f"_in_{new}") for new in sums}).drop("_bucket", "_key", "_at_key", "_at_bucket", *(f"_{p}_{new}" for new in sums for p in ("before", "in")))
