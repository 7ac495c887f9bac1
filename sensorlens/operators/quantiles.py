"""Exact order statistics without a sort: a histogram whose cuts are quantiles is refined until one value is left.

A round summarises what may still hold the wanted rank by a few cuts, which are values of the data, and counts exactly what lies
on and between them. The rank is then on a cut, and found, or between two, and the next round looks there alone. No task holds
more than its share of the rows, whatever their values: ties lie on cuts, and an outlier takes no width from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import settled

CUTS = 32


def _selected(rows: DataFrame, ranks: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``key, rank, value`` of ``ranks`` (``key, rank``, from 0) among ``x`` of ``rows`` (``key, x``)."""
    nothing = F.lit(None).cast("double")
    targets = settled(ranks.select("key", "rank", nothing.alias("low"), nothing.alias("high"), F.lit(0).cast("long").alias("below"), nothing.alias("value")), "ranks")
    shares = [k / CUTS for k in range(CUTS + 1)]
    for _ in range(most_rounds):
        wanted = targets.where("value is null")
        if wanted.isEmpty():
            return targets.select("key", "rank", "value")
        inside = rows.join(wanted.drop("value"), "key").where("(low is null or x > low) and (high is null or x < high)")
        cuts = inside.groupBy("key", "rank").agg(F.array_distinct(F.percentile_approx("x", shares, 1_000)).alias("cuts"))
        placed = inside.join(cuts, ["key", "rank"]).withColumns({"cell": F.size(F.filter("cuts", lambda c: c < F.col("x"))), "on": F.array_contains("cuts", F.col("x"))})
        cells = placed.groupBy("key", "rank", "cell", "on").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("low", "high", "below", "cuts")))
        # A cell is the values over the cut before it and below the next one, or that next one itself.
        before = W.partitionBy("key", "rank").orderBy("cell", "on").rowsBetween(W.unboundedPreceding, -1)
        found = cells.withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0))).where("before <= rank and rank < before + n")
        at = lambda k: F.get("cuts", k)
        narrowed = found.select(
            "key", "rank", F.coalesce(at(F.col("cell") - 1), "low").alias("low"), F.coalesce(at(F.col("cell")), "high").alias("high"), F.col("before").alias("below"), F.when(F.col("on"), at(F.col("cell"))).alias("value")
        )
        targets = settled(targets.where("value is not null").unionByName(narrowed), "ranks")
    raise RuntimeError(f"ranks not found after {most_rounds} rounds")


def exact_quantiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """``keys`` and, for each ``name: share`` of ``shares``, the value at ``share`` of the way from the least to the greatest,
    between two rows in proportion. Nulls and NaN take no part; keys with nothing else give no row. Null keys are a group.
    """
    key = F.struct(*map(F.col, keys)) if keys else F.struct(F.lit(0).alias("all"))  # never null, so that null keys join
    rows = df.select(key.alias("key"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    given = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items()))
    places = rows.groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") - 1).alias("last"), F.explode(given).alias("s"))
    places = settled(places.select("key", "s.name", (F.col("s.share") * F.col("last")).alias("at")), "places")
    floor, ceil = F.floor("at"), F.ceil("at")
    found = _selected(rows, places.select("key", F.explode(F.array(floor, ceil)).alias("rank")).distinct())
    low, high = found.select("key", F.col("rank").alias("floor"), F.col("value").alias("a")), found.select("key", F.col("rank").alias("ceil"), F.col("value").alias("b"))
    both = places.withColumns({"floor": floor, "ceil": ceil}).join(low, ["key", "floor"]).join(high, ["key", "ceil"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("floor")))
    wide = both.withColumn("v", between).groupBy("key").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    return wide.select(*(F.col("key")[k].alias(k) for k in keys), *shares)


def balanced_buckets(df: DataFrame, value: str, buckets: int = 1_024) -> Column:
    """A bucket from 0 for each value, rising with it, of about as many rows each; rows with one value share a bucket.

    ``buckets`` is a power of two. The cuts are quantiles of the data, ``buckets - 1`` numbers.
    """
    depth = buckets.bit_length() - 1
    shares = [k / buckets for k in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10 * buckets).alias("cuts")).first().cuts
    if not cuts:
        return F.lit(0)
    held = F.lit(cuts).cast("array<double>")
    x = F.col(value).cast("double")
    # How many cuts are smaller, by halving.
    step = lambda low, k: F.when(F.get(held, low + k - 1) < x, low + k).otherwise(low)
    return F.aggregate(F.lit([1 << k for k in reversed(range(depth))]), F.lit(0), step)
