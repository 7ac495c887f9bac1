"""Evaluation of generated answers: engagement of sessions, rates over scores, and overlap of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.walks import common_words
from .quantiles import exact_quantiles

FACTORS = [0.2, 0.4, 0.6, 0.8, 1.0]
CONSISTENT, HALLUCINATED = 0.75, 0.45


def reference_answers(corpus: DataFrame, order: str = "ord") -> DataFrame:
    """``command, reference``: the last answer of each trimmed instruction; empty sides are left out."""
    rows = corpus.select(F.trim("instruction").alias("command"), F.trim("output").alias("reference"), order).where("command <> '' and reference <> ''")
    return rows.groupBy("command").agg(F.max_by("reference", order).alias("reference"))


def first_commands(rows: DataFrame, key: str, order: str, k: int = 10) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("place") <= k)


def matched(commands: DataFrame, reference: DataFrame) -> DataFrame:
    return commands.join(reference, "command")


def with_any_match(sessions: DataFrame, commands: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """The sessions of which at least one command is in ``reference``."""
    return sessions.join(matched(commands, reference).select(key), key, "left_semi")


def with_flag(rows: DataFrame, flagged: DataFrame, key: str, name: str = "flagged") -> DataFrame:
    """``rows`` with whether ``flagged`` has their key."""
    known = flagged.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def engagement(sessions: DataFrame, factors: list[float] | None = None) -> DataFrame:
    """Rows of ``n`` commands, ``dur`` seconds and ``quality`` for each factor, with what quality adds and the index of both.

    The index is added commands to added seconds, 0 where no time is added; the second index is 1 + quality.
    """
    given = F.array(*map(F.lit, factors or FACTORS))
    rows = sessions.where("n > 0 and dur > 0").withColumn("factor", F.explode(given))
    commands = F.col("n") * (1 + F.col("quality") * F.col("factor"))
    rows = rows.withColumn("llm_n", commands).withColumn("llm_dur", F.col("llm_n") * (F.col("dur") / F.col("n")))
    more, longer = F.col("llm_n") - F.col("n"), F.col("llm_dur") - F.col("dur")
    return rows.withColumns({"aei": F.when(F.abs(longer) > 1e-6, more / longer).otherwise(0.0), "aei2": 1 + F.col("quality")})


def engagement_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of each ``keys``; the median is exact, and no task holds a group's values for it."""
    increase = lambda a, b, least: (F.sum(b) - F.sum(a)) / F.greatest(F.sum(a), F.lit(least)) * 100
    figures = rows.groupBy(*keys).agg(
        F.count("*").alias("sessions"), F.avg("aei").alias("mean_aei"), F.min("aei").alias("min_aei"), F.max("aei").alias("max_aei"),
        increase("n", "llm_n", 1.0).alias("command_increase_pct"), increase("dur", "llm_dur", 0.01).alias("duration_increase_pct"),
    )
    medians = exact_quantiles(rows, "aei", keys, {"median_aei": 0.5}).select(F.struct(*keys).alias("_key"), "median_aei")
    return figures.join(medians, F.struct(*keys) == F.col("_key")).drop("_key")


def quality_rates(samples: DataFrame, keys: list[str], hypothesis: str = "hypothesis") -> DataFrame:
    """Shares of samples that are consistent and that are hallucinated: a low score, or a phrase that gives the model away."""
    low, leak = F.col("f1") < HALLUCINATED, T.leaks(F.col(hypothesis))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if(F.col("f1") >= CONSISTENT).alias("consistent"), F.count_if(low).alias("semantic"), F.count_if(leak).alias("leaked"), F.count_if(low | leak).alias("hallucinated"),
        F.avg("f1").alias("mean_f1"), F.avg(F.when(~(low | leak), F.col("f1"))).alias("mean_f1_of_rest"),
    )


def stitched(first: DataFrame, second: DataFrame, suffix: str = "_second") -> DataFrame:
    """One row with the figures of two one-row results; those of ``second`` that ``first`` has too get ``suffix``."""
    renamed = second.select(*(F.col(c).alias(c + suffix if c in first.columns else c) for c in second.columns))
    return first.limit(1).crossJoin(F.broadcast(renamed.limit(1)))  # one row each


def band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.55, "middle").otherwise("low")


def _grams(text: Column, n: int) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    if n == 1:
        return words
    grams = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))
    return T.bound(words, lambda ws: F.when(F.size(ws) >= n, grams(ws)).otherwise(F.array().cast("array<string>")))


def overlap(samples: DataFrame, key: str, n: int = 1, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``key`` with matched, reference and hypothesis n-grams, precision, recall and F1, each gram counted at most as often as in both."""
    side = lambda c, r: F.transform(_grams(F.col(c), n), lambda g: F.struct(g.alias("gram"), F.lit(r).alias("r"), F.lit(1 - r).alias("h")))
    grams = samples.select(key, F.explode(F.concat(side(reference, 1), side(hypothesis, 0))).alias("g"))
    both = grams.groupBy(key, "g.gram").agg(F.sum("g.r").alias("r"), F.sum("g.h").alias("h"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = both.groupBy(key).agg(F.sum(F.least(zero("r"), zero("h"))).alias("matched"), F.sum(zero("r")).alias("in_reference"), F.sum(zero("h")).alias("in_hypothesis"))
    m, r, h = F.col("matched"), F.col("in_reference"), F.col("in_hypothesis")
    return sums.withColumns({"precision": T.ratio(m, h), "recall": T.ratio(m, r), "f1": T.ratio(2 * m, r + h)})


def corpus_bleu(samples: DataFrame, key: str, most: int = 4, **names) -> DataFrame:
    """One row: BLEU over all samples with brevity penalty, precisions from ``overlap`` of 1 to ``most`` words."""
    parts = None
    for n in range(1, most + 1):
        row = overlap(samples, key, n, **names).agg(F.lit(n).alias("n"), F.sum("matched").alias("m"), F.sum("in_hypothesis").alias("h"), F.sum("in_reference").alias("r"))
        parts = row if parts is None else parts.unionByName(row)
    logs = F.avg(F.when(F.col("m") > 0, F.log(F.col("m") / F.col("h"))).otherwise(float("-inf")))
    first = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    penalty = F.when(first("h") > first("r"), 1.0).when(first("h") > 0, F.exp(1 - first("r") / first("h"))).otherwise(0.0)
    return parts.agg((penalty * F.exp(logs)).alias("bleu"))


def longest_common(samples: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``samples`` with ``lcs``, the words of the longest common subsequence, and ``rouge_l``."""

    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    out = samples.withColumn("lcs", common_words(F.col(reference), F.col(hypothesis)))
    return out.withColumn("rouge_l", T.ratio(2 * F.col("lcs"), words(reference) + words(hypothesis)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
