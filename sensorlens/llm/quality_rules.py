"""Quality rules: a decision list learnt by sequential covering, in DataFrame expressions throughout.

Statistics of each text are one row of numbers, made once and kept. Thresholds to choose from are quantiles of each number
among good and among bad labelled rows. A rule grows by the condition of greatest information gain on two thirds of the
labelled rows, loses its last conditions if the other third says so, and is kept if it is precise enough there; the rows it
covers are then set aside. Each step is one aggregation over all labelled rows that returns counts by feature and bin, at
most a few hundred rows. The list ends as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, settled

SYMBOLS = "#*$%&|<>"
#: What rules may speak about: name -> expression over the columns of ``text_statistics``.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbol_share": lambda: _share("n_symbols", "word_chars"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "capital_share": lambda: _share("n_capitals", "word_chars"),
    "distinct_share": lambda: _share("n_distinct_words", "n_words"),
}


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts over the words and lines of whole texts; a null text has none. ``keep``: columns to carry along."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, "^" + SPACE, "")) > 0)
    base = docs.select(*keep, text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i"))))
    kept = F.array_join("_words", "")
    counted = base.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(kept).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(kept, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(kept, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.sort_array(windows).alias("_sorted"),
    )
    # Equal windows are neighbours once sorted; their places, sorted again, say how many words they cover.
    near = lambda s, j: (s["h"] == F.get("_sorted", j - 1)["h"]) | (s["h"] == F.get("_sorted", j + 1)["h"])
    twice = F.sort_array(F.array_compact(F.transform("_sorted", lambda s, j: F.when(near(s, j), s["i"]))))
    placed = counted.withColumn("_twice", twice).drop("_sorted")
    steps = F.transform("_twice", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_twice", k + 1) - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return placed.withColumn("n_repeat_words", covered).drop("_twice")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold

    def on_bins(self, cuts: dict[str, list[float]]) -> Column:
        """The same over a row of bins; a bin is the number of cuts below the value."""
        k = cuts[self.feature].index(self.threshold)
        return F.col(self.feature) > k if self.above else F.col(self.feature) <= k

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def candidate_cuts(labelled: DataFrame, quantiles: int) -> dict[str, list[float]]:
    at = [k / quantiles for k in range(quantiles + 1)]
    sides = [F.percentile_approx(F.when(F.col("bad") == b, FEATURES[f]()), at, 10_000).alias(f"{f}_{b}") for f in FEATURES for b in (0, 1)]
    row = labelled.agg(*sides).first()
    return {f: sorted({x for b in (0, 1) for x in row[f"{f}_{b}"] or []}) for f in FEATURES}


def learn_rules(statistics: DataFrame, labels: DataFrame, most_rules: int = 8, most_conditions: int = 3, least_precision: float = 0.95, least_cover: int = 5, quantiles: int = 24) -> list[Rule]:
    """Rules that find the rows of ``quality`` 0, in order. Needs ``doc_id`` on both sides.

    Labels that are null or name no document are left out; of several labels of a document the lowest counts. Without
    bad or without good rows there are no rules. Ties between conditions go to the first feature by name, then the lowest
    threshold.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = settled(statistics.join(known, "doc_id").withColumn("bad", (F.col("quality") == 0).cast("int")), "labelled")
    cuts = candidate_cuts(labelled, quantiles)
    if any(not c for c in cuts.values()):
        return []
    bins = [reduce(lambda a, b: a + b, [(FEATURES[f]() > t).cast("int") for t in c]).alias(f) for f, c in cuts.items()]
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).cast("int").alias("fold")
    cells = labelled.select(fold, *bins, "bad").groupBy("fold", *FEATURES).agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    cells = settled(cells, "cells")

    def counts(conditions: Rule, left: Column) -> dict[tuple[int, str, int], tuple[int, int]]:
        rows = cells.where(left & _all(c.on_bins(cuts) for c in conditions))
        long = rows.select("fold", "p", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES))).alias("x"))
        return {(r["fold"], r["feature"], r["bin"]): (r["p"], r["n"]) for r in long.groupBy("fold", "x.feature", "x.bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}

    def total(conditions: Rule, left: Column, fold: int) -> tuple[int, int]:
        r = cells.where(left & (F.col("fold") == fold) & _all(c.on_bins(cuts) for c in conditions)).agg(F.sum("p"), F.sum("n")).first()
        return r[0] or 0, r[1] or 0

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            found = counts(rule, left)
            grow = {k[1:]: v for k, v in found.items() if k[0] == 0}
            p0, n0 = (sum(v[i] for k, v in grow.items() if k[0] == "n_words") for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in sorted(FEATURES):
                below_p = below_n = 0
                for k, t in enumerate(cuts[f]):
                    p, n = grow.get((f, k), (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for above, (a, b) in ((True, (p0 - below_p, n0 - below_n)), (False, (below_p, below_n))):
                        if a >= least_cover:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(f, above, t))
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            p, n = total(rule[:k], left, 1)
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        value, k, p, n = max(worth)
        rule = rule[:-k]
        if p < least_cover or p / (p + n) < least_precision:
            break
        rules.append(rule)
        left = left & ~_all(c.on_bins(cuts) for c in rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(_all(c.column() for c in rules[0]), 1)
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(_all(c.column() for c in rule), k)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the number of the ``rule`` that rejects, for each row of ``docs``.

    A null or empty text has no words and fails the base. Rows with equal or null ``doc_id`` stay rows of their own; null
    ones take no part in learning. An empty table gives no rows.
    """
    statistics = settled(text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "statistics")
    rules = learn_rules(statistics, labels, **options)
    out = statistics.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that neither the base nor a rule rejects, with all their columns.

    Counts are made once and written beside the rows; the rules are learnt from the counts alone.
    """
    counted = settled(text_statistics(docs.select(F.struct("*").alias("_row"), "text"), ["_row"]), "counted")
    rules = learn_rules(counted.withColumn("doc_id", F.col("_row.doc_id").cast("long")).drop("_row"), labels, **options)
    return counted.where(~base_failed() & verdict(rules).isNull()).select("_row.*")
