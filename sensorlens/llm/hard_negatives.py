"""Hard negatives by segment summaries: means and deviations bound inner products before any product is taken.

1. A store holds each vector in whole numbers with the mean and the deviation of its segments, at several levels: the whole,
   quarters, sixteenths. Over a segment of n components, sum(x * y) lies within n * (mean * mean +- deviation * deviation).
2. Rows are dealt into blocks of a bounded size by a hash of their number, anchors too, and a block of rows meets a block of
   anchors in one group: for positives among the rows of a label, for negatives among all. No block grows with the table or a
   label; anchors are the stated query set, so their meetings with all rows are what is asked.
3. In a group, level by level, pairs that the bounds rule out go, and only what is left is scored exactly, in 64-bit integers.
4. Each group gives the best few of each anchor, and ranks over these, a few for each anchor and block, give the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import settled

#: Segments of a vector at each level; the width is filled up with zeros to a multiple of the last.
LEVELS = (1, 4, 16)
#: Components further out count as this much, so that an integer product of 64 of them fits in 64 bits.
MOST = 1 << 28

STORED = "row long, vec_id long, label long, anchor boolean, vector binary, means binary, deviations binary"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part: ``vector`` has floor(256 * x) of each component.

    Rows with a null ``vec_id``, a null label, a null vector or a component that is null, infinite or no number take no part.
    """
    x = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    whole = F.transform("x", lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(256 * x).cast("double"))).cast("long"))
    return rows.where("vec_id is not null and label is not null and x is not null").where(finite).select("vec_id", "label", whole.alias("vector"))


def summarised(vectors: DataFrame, anchors: Column, label: str) -> DataFrame:
    """The store: a row for each of ``vectors`` with its number, its components, and its segments' means and deviations, written.

    Vectors shorter than the longest are filled up with zeros, which changes no product.
    """
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    width = -(-longest // LEVELS[-1]) * LEVELS[-1]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            sizes = np.diff(ends)
            full = np.zeros((len(sizes), width), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            full[row, np.arange(len(flat)) - ends[row]] = flat
            means, deviations = zip(*((s.mean(2), s.std(2)) for s in (full.reshape(len(full), n, -1).astype(np.float64) for n in LEVELS)))
            packed = [np.ascontiguousarray(x) for x in (full.astype(np.int32), np.concatenate(means, 1), np.concatenate(deviations, 1))]
            binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "anchor")), *binary], ["row", "vec_id", "label", "anchor", "vector", "means", "deviations"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce(anchors, F.lit(False)).alias("anchor"), "vector")
    return settled(numbered.mapInArrow(made, STORED), label)


# --- in a group


class Block(NamedTuple):
    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray  # int64, a row for each
    means: list[np.ndarray]  # by level
    deviations: list[np.ndarray]

    def take(self, at) -> "Block":
        return Block(self.row[at], self.vec_id[at], self.label[at], self.vectors[at], [m[at] for m in self.means], [d[at] for d in self.deviations])


def block(rows: pa.Table) -> Block:
    def matrix(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(rows.num_rows, -1)

    cuts = np.cumsum(LEVELS)[:-1]
    means, deviations = (np.split(matrix(c, np.float64), cuts, axis=1) for c in ("means", "deviations"))
    return Block(*(rows.column(c).to_numpy() for c in ("row", "vec_id", "label")), matrix("vector", np.int32).astype(np.int64), means, deviations)


def slack(anchors: Block, rows: Block) -> float:
    """More than rounding can take from a bound."""
    length = lambda b: float(np.sqrt((b.vectors.astype(np.float64) ** 2).sum(1).max(initial=0)))
    return 0.5 + 1e-9 * length(anchors) * length(rows)


def bounds(anchors: Block, rows: Block, level: int, i: np.ndarray | None = None, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores at ``level``: of all pairs as a matrix, or of the pairs ``i, j``."""
    n = rows.vectors.shape[1] // LEVELS[level]
    am, ad, rm, rd = anchors.means[level], anchors.deviations[level], rows.means[level], rows.deviations[level]
    if i is None:
        middle, width = n * (am @ rm.T), n * (ad @ rd.T)
    else:
        middle, width = n * np.einsum("ij,ij->i", am[i], rm[j]), n * np.einsum("ij,ij->i", ad[i], rd[j])
    return middle - width, middle + width


def left_over(anchors: Block, rows: Block, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the ``allowed`` pairs whose score lies from the anchor's ``least`` to its ``most``: bounds from level to level, then exactly."""
    off = slack(anchors, rows)
    low, high = bounds(anchors, rows, 0)
    at_least, at_most = least - off, most + off
    i, j = np.nonzero(allowed & (high >= at_least[:, None]) & (low <= at_most[:, None]))
    for level in range(1, len(LEVELS)):
        low, high = bounds(anchors, rows, level, i, j)
        keep = (high >= at_least[i]) & (low <= at_most[i])
        i, j = i[keep], j[keep]
    score = np.einsum("ij,ij->i", anchors.vectors[i], rows.vectors[j])
    keep = (score >= least[i]) & (score <= most[i])
    return i[keep], j[keep], score[keep]


def first_of_each(owner: np.ndarray, score: np.ndarray, vec_id: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of each owner: higher scores first, then lower ids."""
    order = np.lexsort((vec_id, -score, owner))
    sorted_owner = owner[order]
    start = np.searchsorted(sorted_owner, sorted_owner)
    return order[np.arange(len(order)) - start < most]


def _pieces(anchors: Block, step: int = 32) -> Iterator[Block]:
    for at in range(0, len(anchors.row), step):
        yield anchors.take(slice(at, at + step))


def best_alike(anchors: Block, rows: Block, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor row, anchor id, row, id, score): for each anchor its ``most`` best other rows of the block."""
    for part in _pieces(anchors):
        other = part.row[:, None] != rows.row[None, :]
        # The rows that the coarse bounds put first are scored at once: the last of them is a floor for all others.
        guess = np.where(other, bounds(part, rows, 0)[1], -np.inf)
        k = min(most, len(rows.row))
        top = np.argpartition(-guess, k - 1, axis=1)[:, :k]
        known = np.where(np.take_along_axis(other, top, 1), np.einsum("id,ikd->ik", part.vectors, rows.vectors[top]), np.iinfo(np.int64).min)
        floor = known.min(1) if k == most else np.full(len(part.row), np.iinfo(np.int64).min)
        i, j, score = left_over(part, rows, other, floor, np.full(len(part.row), np.iinfo(np.int64).max))
        at = first_of_each(i, score, rows.vec_id[j], most)
        yield part.row[i[at]], part.vec_id[i[at]], rows.row[j[at]], rows.vec_id[j[at]], score[at]


# --- blocks that meet


def _met(anchors: DataFrame, rows: DataFrame, key: Column, row_block: int, anchor_block: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``key, a, b``: block ``a`` of the anchors of a key and block ``b`` of its rows, every anchor block with every row block."""
    anchors, rows = anchors.withColumn("key", key), rows.withColumn("key", key)
    n = lambda size: F.ceil(F.count("*") / size).cast("int")
    blocks = anchors.groupBy("key").agg(n(anchor_block).alias("of_anchors")).join(rows.groupBy("key").agg(n(row_block).alias("of_rows")), "key")
    mine = lambda count: F.pmod(F.xxhash64("row"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = anchors.join(blocks, "key").withColumn("a", mine("of_anchors")).withColumn("b", each("of_rows"))
    right = rows.join(blocks, "key").withColumn("b", mine("of_rows")).withColumn("a", each("of_anchors"))
    # Under names of their own, so that the two sides of one store are told apart.
    return tuple(side.select(*(F.col(c).alias(c) for c in side.columns if not c.startswith("of_"))) for side in (left, right))


def positives(store: DataFrame, most: int = 5, row_block: int = 4_096, anchor_block: int = 1_024) -> DataFrame:
    """``anchor_row, anchor_id, positive_id, positive_score, place``: for each anchor the first ``most`` other rows of its label."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = list(best_alike(block(anchors), block(rows), most)) if anchors.num_rows and rows.num_rows else []
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("anchor_row", "anchor_id", "row", "positive_id", "positive_score"), columns)))

    left, right = _met(store.where("anchor"), store, F.col("label"), row_block, anchor_block)
    schema = "anchor_row long, anchor_id long, row long, positive_id long, positive_score long"
    met = left.groupBy("key", "a", "b").cogroup(right.groupBy("key", "a", "b")).applyInArrow(meet, schema)
    place = F.row_number().over(W.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "row"))
    return met.withColumn("place", place).where(F.col("place") <= most).drop("row")


def negatives(store: DataFrame, chosen: DataFrame, most: int = 3, row_block: int = 4_096, anchor_block: int = 1_024) -> DataFrame:
    """``anchor_row, place, negative_id, negative_score, rank``: for each row of ``chosen`` the first ``most`` rows of other labels
    that score from half of its positive's score to 95 % of it."""
    # 50 p <= 100 n <= 95 p in whole numbers; for a negative p there is no n.
    exact = lambda p: (-((-p) // 2), p * 19 // 20)
    asked = chosen.where("positive_score >= 0").groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("asked"))  # a few for each anchor
    anchors = store.where("anchor").join(asked, F.col("row") == F.col("anchor_row")).drop("anchor_row")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            anchors, rows = block(left), block(right)
            of = {row: [(x["place"], *exact(x["positive_score"])) for x in asks] for row, asks in zip(left.column("row").to_pylist(), left.column("asked").to_pylist())}
            for part in _pieces(anchors):
                asks = [of[row] for row in part.row.tolist()]
                lows, highs = (np.array([f(x[k] for x in ask) for ask in asks], np.int64) for k, f in ((1, min), (2, max)))
                i, j, score = left_over(part, rows, part.label[:, None] != rows.label[None, :], lows, highs)
                # Each pair with each of its anchor's asks, a few at most.
                for k in range(max(map(len, asks))):
                    place, low, high = (np.array([ask[k][c] if k < len(ask) else (0, 1, 0)[c] for ask in asks], np.int64) for c in range(3))
                    fits = np.flatnonzero((score >= low[i]) & (score <= high[i]))
                    at = fits[first_of_each(i[fits], score[fits], rows.vec_id[j[fits]], most)]
                    out.append((part.row[i[at]], place[i[at]], rows.row[j[at]], rows.vec_id[j[at]], score[at]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("anchor_row", "place", "row", "negative_id", "negative_score"), columns)))

    left, right = _met(anchors, store, F.lit(0), row_block, anchor_block)
    schema = "anchor_row long, place long, row long, negative_id long, negative_score long"
    met = left.groupBy("key", "a", "b").cogroup(right.groupBy("key", "a", "b")).applyInArrow(meet, schema)
    rank = F.row_number().over(W.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id", "row"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).drop("row")


def hard_negatives(vectors: DataFrame, anchors: Column, most_positives: int = 5, most_negatives: int = 3, **blocks) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, label, vector``).

    ``anchors`` says which rows ask. Rows with an equal ``vec_id`` are rows of their own: each asks, and each may be the other's
    positive. Ties go by ``vec_id``. An anchor without positives, and a positive without a negative in its range, give no row,
    and so does an empty table.
    """
    store = summarised(vectors, anchors, "summaries")
    chosen = settled(positives(store, most_positives, **blocks), "positives")
    found = negatives(store, chosen, most_negatives, **blocks)
    joined = chosen.withColumn("place", F.col("place").cast("long")).join(found, ["anchor_row", "place"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame, **options) -> DataFrame:
    """``hard_negatives`` of the table of embeddings: every 7th id gets the next label of ten, every 50th is an anchor."""
    rows = integer_vectors(embeddings)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0, **options)


ORACLE_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS anchor_row, a.vec_id AS anchor_id, r.row, r.vec_id, r.label = a.label AS alike, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM given a JOIN given r ON a.row <> r.row WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id, row) AS place FROM scored WHERE alike QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_row, p.place ORDER BY n.score DESC, n.vec_id, n.row)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_row = p.anchor_row AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
