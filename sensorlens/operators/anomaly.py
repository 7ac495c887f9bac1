"""Isolation forest: trees are grown in tasks, one sample each, and score rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .mlprep import cleaned
from .quantiles import exact_quantiles


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, float]]:
    """Nodes (feature or -1, threshold, right child, path length at a leaf); the left child is the next node."""
    nodes: list[tuple[int, float, int, float]] = []

    def build(rows: np.ndarray, depth: int) -> None:
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            nodes.append((-1, 0.0, -1, depth + float(_average_path(len(rows)))))
            return
        f = int(rng.choice(spread))
        t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        at = len(nodes)
        nodes.append((f, t, -1, 0.0))
        build(rows[rows[:, f] < t], depth + 1)
        nodes[at] = (f, t, len(nodes), 0.0)
        build(rows[rows[:, f] >= t], depth + 1)

    build(x, 0)
    return nodes


FOREST = "tree int, node int, feature int, threshold double, right int, path double"


def fit(train: DataFrame, features: list[str], key: str, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """``tree, node, feature, threshold, right, path``: each tree from about ``sample`` rows, chosen by a hash of ``key``.

    Of large tables a row is in one tree at most, so that only the rows of all samples are carried on.
    """
    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group.sort_values(key)[features].to_numpy(float)
        nodes = _grow(x, np.random.default_rng(seed + tree), int(np.ceil(np.log2(max(2, sample)))))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    share = min(1.0, sample / max(1, train.count()))
    rows, draw = cleaned(train, features).select(key, *features), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    if share * trees <= 1:  # a row is in one tree at most: the draw says whether and in which
        dealt = rows.withColumn("tree", F.floor(draw / (share * (1 << 40))).cast("int")).where(F.col("tree") < trees)
        return dealt.groupBy("tree").applyInPandas(build, FOREST)
    dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(F.pmod(F.xxhash64(key, "tree", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return dealt.groupBy("tree").applyInPandas(build, FOREST)


def score(df: DataFrame, forest: DataFrame, features: list[str], sample: int = 256) -> DataFrame:
    """``df`` with ``score`` from 0 to 1, near 1 for the odd ones. The forest has at most trees * 2 * sample rows."""
    table = forest.orderBy("tree", "node").toPandas()
    built = [g[["feature", "threshold", "right", "path"]].to_numpy(float) for _, g in table.groupby("tree")]
    sent = df.sparkSession.sparkContext.broadcast(built)
    norm = float(_average_path(float(sample)))

    @F.pandas_udf("double")
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            depth = np.zeros(len(x))
            for nodes in sent.value:
                at = np.zeros(len(x), int)
                while True:
                    inner = nodes[at, 0] >= 0
                    if not inner.any():
                        break
                    f = np.maximum(nodes[at, 0], 0).astype(int)
                    left = x[np.arange(len(x)), f] < nodes[at, 1]
                    at = np.where(inner, np.where(left, at + 1, nodes[at, 2].astype(int)), at)
                depth += nodes[at, 3]
            yield pd.Series(2 ** (-depth / max(1, len(sent.value)) / norm))

    return cleaned(df, features).withColumn("score", isolation(*features))


def rare(train: DataFrame, label: str, least: int = 50) -> bool:
    """Whether a label has too few positives for a classifier, so that the forest is the way to it."""
    return train.where(F.col(label) == 1).limit(least).count() < least


def flagged(train_scores: DataFrame, scored: DataFrame, contamination: float = 0.01) -> DataFrame:
    """``scored`` with ``prediction`` 1 where the score is over all but ``contamination`` of the training scores."""
    cut = exact_quantiles(train_scores, "score", [], {"cut": 1 - contamination})
    return scored.crossJoin(F.broadcast(cut)).withColumn("prediction", (F.col("score") > F.col("cut")).cast("int")).drop("cut")  # one row
