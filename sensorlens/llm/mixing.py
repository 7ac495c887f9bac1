"""Mixing sources to target weights, in DataFrame expressions throughout.

Words are summed by source, the targets of all sources follow from weights and caps, and each document of a source is
taken ``floor(rate)`` times, and once more if a draw seeded by its id falls below the rest of the rate. Draws come from an
MD5 over the id, so that reruns and other engines agree. A source takes, of ``TRIES`` independent sets of draws, the one
that lands nearest its target. In each set a document is drawn with its probability; over the choice of a set that holds
only nearly, and in small sources documents that fill the gap to the target are somewhat likelier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, placed_in_order, settled

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
TRIES = 32


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights go round by source in code point order, null last. All sources share the sum of all sizes by weight; where a
    share is over ``most`` times the size it stops there, and the excess goes to the others by weight. With sources in
    order of cap / weight those that stop come first, and which they are shows from running sums.
    """
    first = placed_in_order(sizes, [F.col("source").isNull(), F.col("source")], {}, "sources")
    by = F.pmod(F.col("place"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (by + 1).cast("int")).cast("long")
    capped = first.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    ratio = F.col("cap") / F.col("weight")
    ordered = placed_in_order(capped, [ratio, F.col("source").isNull(), F.col("source")], {"cap_before": "cap", "weight_before": "weight"}, "ratios")
    sums = capped.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    stops = ratio * (F.col("all_weight") - F.col("weight_before")) <= F.col("all_size") - F.col("cap_before")
    flagged = ordered.crossJoin(F.broadcast(sums)).withColumn("stops", stops)  # one row
    level = flagged.agg(
        (F.max("all_size") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))), F.lit(0))).alias("rest"),
        (F.max("all_weight") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("weight"))), F.lit(0))).alias("rest_weight"),
    )
    share = F.col("rest").cast("double") * F.col("weight") / F.col("rest_weight")
    target = F.when(F.col("stops") | (F.col("rest_weight") == 0), F.col("cap").cast("double")).otherwise(share)
    return flagged.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))  # one row


def draws(doc_id: Column) -> Column:
    """``TRIES`` numbers from 0 to 1 for a document: each MD5 gives four, of 32 bits."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    sums = [F.md5(F.concat(key, F.lit(f"/{k}"))) for k in range(TRIES // 4)]
    return F.array(*(F.conv(F.substring(m, 1 + 8 * j, 8), 16, 10).cast("double") / 4294967296.0 for m in sums for j in range(4)))


def mixing_plan(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, rate, try`` for each source of ``doc_id, source, size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settled(source_targets(totals), "targets").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    right = targets.select(F.col("source").alias("_source"), "rate")
    drawn = sizes.where("size > 0").join(right, F.col("source").eqNullSafe(F.col("_source"))).select("source", "size", "rate", F.posexplode(draws(F.col("doc_id"))).alias("try", "u"))
    taken = drawn.groupBy("source", "try").agg(F.sum(F.col("size") * copies(F.col("rate"), F.col("u"))).alias("taken"))
    left = taken.select(F.col("source").alias("_source"), "try", "taken")
    off = left.join(targets, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("target")).alias("off"), "try")).alias("best"))
    best = off.select(F.col("source").alias("_source"), "best.try")
    return targets.join(best, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "rate", F.coalesce("try", F.lit(0)).alias("try"))


def copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def _with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """``df`` with its source's ``_target``, ``_source_size`` and each document's ``_copies``."""
    p = plan.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"), F.col("try").alias("_try"))
    joined = df.join(p, F.col("_key").eqNullSafe(F.col("_source")))
    return joined.withColumn("_copies", copies(F.col("_rate"), F.get(draws(F.col("_doc")), F.col("_try"))))


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    A null text has no words and a document of no words is taken as no words. A null source is a source, the last one.
    Rows with equal ``doc_id`` share their draws. An empty table gives no rows.
    """
    sizes = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size")), "sizes")
    plan = settled(mixing_plan(sizes), "mix")
    full = _with_plan(sizes.withColumns({"_key": F.col("source"), "_doc": F.col("doc_id")}), plan)
    return full.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


def emit_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns. Rows without words are taken by their
    source's rate like any other; those of sources without any word are left out."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    plan = settled(mixing_plan(settled(named, "sizes")), "mix")
    row = docs.select(F.struct("*").alias("_row"), F.col("source").cast("string").alias("_key"), F.col("doc_id").cast("long").alias("_doc"))
    full = _with_plan(row, plan).where("_copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return full.select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap,
  [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS ratio, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before FROM w
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, ratio * (all_weight - weight_before)::DOUBLE <= (all_size - cap_before)::DOUBLE AS stops FROM o),
l AS (SELECT max(all_size)::DOUBLE - coalesce(sum(CASE WHEN stops THEN cap END), 0)::DOUBLE AS rest,
  max(all_weight) - coalesce(sum(CASE WHEN stops THEN weight END), 0) AS rest_weight FROM f),
t AS (SELECT source, source_size,
  CASE WHEN stops OR rest_weight = 0 THEN cap::DOUBLE ELSE rest * weight::DOUBLE / rest_weight::DOUBLE END AS target FROM f, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, k.k AS try, d.size * (floor(r.rate)::BIGINT +
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '/' || (k.k // 4)::VARCHAR), 1 + 8 * (k.k % 4), 8))::BIGINT::DOUBLE / 4294967296.0
   < r.rate - floor(r.rate))::BIGINT) AS taken
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(32)) AS k) k),
g AS (SELECT source, try, abs(sum(taken)::DOUBLE - max(target)) AS off FROM c GROUP BY source, try),
b AS (SELECT source, try FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, try) = 1)
SELECT c.doc_id, c.size, c.source_size, c.target, c.taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.try = b.try
"""
