"""Random forests over cells, for scores of held-out rows without a model that passes through the driver.

Trees of MLlib's forest see a feature as one of at most 32 bins, so rows of equal bins are one cell, and a cell's rows draw
together: the sum of their Poisson(1) draws is Poisson(rows). Cells are counted by Spark; each task grows trees of its own over
them and returns what they say of each cell. Splits, bootstrap, feature subsets and the merging of leaves are MLlib's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

#: Most cells that go to the tasks (a byte for each feature, and two counts); four features of 32 bins can't have more.
CELLS = 1 << 20
NODES_AT_ONCE = 4096
ERROR = 0.0005


def split_points(rows: DataFrame, columns: list[str], most: int) -> list[list[float]]:
    """For each column up to ``most`` of its values at which its rows part evenly: ``x <= value`` goes left.

    A value that takes several shares parts only once; the shares it leaves are dealt again among the other values.
    """
    found, open_ = {c: set() for c in columns}, list(columns)
    while open_:
        left = {c: most - len(found[c]) for c in open_}
        rest = [F.when(~F.array_contains(F.array(*map(F.lit, sorted(found[c]))), F.col(c)), F.col(c)).alias(c) if found[c] else F.col(c) for c in open_]
        shares = [F.percentile_approx(c, F.array(*(F.lit((k + 1) / (left[c] + 1)) for k in range(left[c]))), round(1 / ERROR)).alias(c) for c in open_]
        row, now = rows.select(*rest).agg(*shares).first(), []
        for c in open_:
            new = set(row[c] or ())
            found[c] |= new
            if 0 < len(new) < left[c]:
                now.append(c)
        open_ = now
    return [sorted(found[c]) for c in columns]


def binned(rows: DataFrame, columns: list[str], points: list[list[float]]) -> DataFrame:
    """``rows`` with ``bins``, the number of split points below each column's value."""
    # A Bucketizer's bins hold their lower edge, these their upper one.
    edges = [[-math.inf, *(math.nextafter(p, math.inf) for p in x), math.inf] for x in points]
    names = [f"_bin_{k}" for k in range(len(columns))]
    some = [k for k, x in enumerate(points) if x]
    if some:
        rows = Bucketizer(inputCols=[columns[k] for k in some], outputCols=[names[k] for k in some], splitsArray=[edges[k] for k in some]).transform(rows)
    return rows.withColumn("bins", F.array(*(F.col(names[k]).cast("tinyint") if points[k] else F.lit(0).cast("tinyint") for k in range(len(columns))))).drop(*names)


def grown(bins: np.ndarray, w0: np.ndarray, w1: np.ndarray, subset: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """The probability of 1 for each cell by one tree, grown on the weights of 0 and 1 level by level."""
    cells, features = bins.shape
    width = int(bins.max(initial=0)) + 1
    at, node, leaf = np.arange(cells), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    levels, begin = [], 0  # of each level: where its nodes begin, weights of 0 and 1, first child (-1: leaf), parents
    parents = np.array([-1])
    for level in range(depth + 1):
        m = len(parents)
        t0, t1 = np.bincount(node, w0[at], m), np.bincount(node, w1[at], m)
        gain, by, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        if level < depth and width > 1:
            before = (t0 * t0 + t1 * t1) / np.maximum(t0 + t1, 1e-300)
            drawn = np.zeros((m, features), bool)
            np.put_along_axis(drawn, np.argsort(rng.random((m, features)), 1)[:, :subset], True, 1)
            mixed, place = (t0 > 0) & (t1 > 0), np.zeros(m, np.int64)
            for f in range(features):
                every = np.flatnonzero(drawn[:, f] & mixed)
                for some in np.split(every, range(NODES_AT_ONCE, len(every), NODES_AT_ONCE)):
                    if not len(some):
                        continue
                    lo, hi = np.searchsorted(node, [some[0], some[-1] + 1])  # cells stand in the order of their nodes
                    place[some] = np.arange(1, len(some) + 1)
                    rows = place[node[lo:hi]]
                    mine = np.flatnonzero(rows) + lo
                    slot = (place[node[mine]] - 1) * width + bins[at[mine], f]
                    place[some] = 0
                    l0, l1 = (np.bincount(slot, w[at[mine]], len(some) * width).reshape(-1, width).cumsum(1)[:, :-1] for w in (w0, w1))
                    r0, r1 = t0[some, None] - l0, t1[some, None] - l1
                    l, r = l0 + l1, r0 + r1
                    both = (l > 1e-9) & (r > 1e-9)
                    better = np.where(both, (l0 * l0 + l1 * l1) / np.where(both, l, 1) + (r0 * r0 + r1 * r1) / np.where(both, r, 1) - before[some, None], 0)
                    best = better.argmax(1)
                    value = better[np.arange(len(some)), best]
                    won = value > np.maximum(gain[some], 1e-9 * before[some])
                    gain[some[won]], by[some[won]], cut[some[won]] = value[won], f, best[won]
        parts = by >= 0
        first = np.where(parts, 2 * (np.cumsum(parts) - 1), -1)
        levels.append((begin, t0, t1, first, parents))
        gone = ~parts[node]
        leaf[at[gone]] = begin + node[gone]
        at, node = at[~gone], node[~gone]
        if not len(at):
            break
        node = first[node] + (bins[at, by[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        at, node, begin = at[order], node[order], begin + m
        parents = np.repeat(np.flatnonzero(parts), 2)
    # As MLlib does, siblings that are leaves of one prediction become their parent.
    ends = [x[3] < 0 for x in levels]
    for k in range(len(levels) - 2, -1, -1):
        first, says = levels[k][3], levels[k + 1][2] > levels[k + 1][1]
        inner = np.flatnonzero(first >= 0)
        one, two = first[inner], first[inner] + 1
        ends[k][inner] = ends[k + 1][one] & ends[k + 1][two] & (says[one] == says[two])
    total, top = [], []
    for k, (begin, t0, t1, _, parents) in enumerate(levels):
        here = begin + np.arange(len(t0))
        if k:
            here = np.where(ends[k - 1][parents], top[-1][parents], here)
        top.append(here)
        total.append(t1 / np.maximum(t0 + t1, 1e-300))
    return np.concatenate(total)[np.concatenate(top)[leaf]]


def scores(train: DataFrame, rest: DataFrame, columns: list[str], labels: list[str], forest: RandomForestClassifier) -> DataFrame | None:
    """``rest`` with ``label_name``, ``label``, ``prediction`` and ``score`` for each of ``labels``, by trees as ``forest`` would fit them to ``train``, classes weighing alike; None if there are too many cells."""
    spark, trees, depth, seed, each = rest.sparkSession, forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed(), range(len(labels))
    points = split_points(train, columns, forest.getMaxBins() - 1)
    rest = binned(rest, columns, points)
    counts = [F.count_if(F.col(f"_y{k}") == v).alias(f"n{v}_{k}") for k in each for v in (0, 1)]
    known = binned(train, columns, points).select("bins", *(F.col(y).cast("int").alias(f"_y{k}") for k, y in enumerate(labels)), F.lit(False).alias("_asked"))
    asked = rest.select("bins", *(F.lit(None).cast("int").alias(f"_y{k}") for k in each), F.lit(True).alias("_asked"))
    cells = known.unionAll(asked).groupBy("bins").agg(*counts, F.max("_asked").alias("asked")).limit(CELLS + 1).toArrow()
    if cells.num_rows > CELLS:
        return None
    bins = cells["bins"].combine_chunks().flatten().to_numpy().astype(np.uint8).reshape(-1, len(columns))
    order = np.lexsort(bins.T[::-1])  # draws go by the cells' order
    held = [[cells[f"n{v}_{k}"].to_numpy()[order] for v in (0, 1)] for k in each]
    weights = [[sum(int(n.sum()) for n in both) / (2.0 * max(1, int(n.sum()))) for n in both] for both in held]
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(bins[order]), held, cells["asked"].to_numpy()[order]))
    subset = len(columns) if trees == 1 else math.ceil(math.sqrt(len(columns)))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, held, wanted = sent.value
        votes, mine = np.zeros((len(held), len(bins))), bins[wanted].astype(np.int8)
        ids = [x for batch in batches for x in batch.column(0).to_pylist()]
        for tree, k in (divmod(x, len(held)) for x in ids):
            rng = np.random.default_rng([seed, tree])
            votes[k] += grown(bins, *(w * rng.poisson(n) for w, n in zip(weights[k], held[k], strict=True)), subset, depth, rng)
        if ids:
            lists = pa.ListArray.from_arrays(np.arange(0, mine.size + 1, mine.shape[1], dtype=np.int32), mine.ravel())
            yield pa.record_batch([lists, *votes[:, wanted]], ["cell", *(f"v{k}" for k in each)])

    todo = spark.range(0, trees * len(labels), 1, min(trees * len(labels), 2 * spark.sparkContext.defaultParallelism))
    said = todo.mapInArrow(grow, ", ".join(["cell array<tinyint>", *(f"v{k} double" for k in each)]))
    said = said.groupBy("cell").agg(*((F.sum(f"v{k}") / trees).alias(f"_score{k}") for k in each))
    says = F.array(*(F.struct(F.lit(y).alias("label_name"), F.col(y).cast("double").alias("label"), (F.col(f"_score{k}") > 0.5).cast("double").alias("prediction"), F.col(f"_score{k}").alias("score")) for k, y in enumerate(labels)))
    own = [c for c in rest.columns if c not in ("bins", *labels)]
    return rest.join(said, F.col("bins") == F.col("cell")).select(*own, F.explode(says).alias("_says")).select(*own, "_says.*")
