"""Hard negatives against plain inner products, and the bounds against the scores they bound."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sensorlens.llm import common, hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, row long, anchor string, means string, key int, a string, b string, place string, rank string"


def want(rows):
    held = []
    for vec_id, x, label, *_ in rows:
        if vec_id is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v = [max(-hard.MOST, min(hard.MOST, math.floor(256 * float(np.float32(c))))) for c in x]
            held.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, v))
    out = []
    for k, (anchor, label, v) in enumerate(held):
        if anchor % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, other) for n, (i, other, w) in enumerate(held) if n != k]
        for p, i, _ in sorted(s[:2] + (0,) for s in scored if s[2] == label)[:5]:
            fits = sorted((n, j) for n, j, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p)
            out += [(anchor, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(8)
    centres = [[draw.gauss(0, 0.5) for _ in range(20)] for _ in range(4)]
    rows = []
    for k in range(600):
        c = draw.randrange(4)
        x = [draw.gauss(m, 0.3) for m in centres[c]]
        rows.append((draw.choice([k, k, k, 50 * (k // 50)]), x[: draw.choice([20, 20, 20, 7, 0])], draw.choice([c, c, c, 9])))
    nan, inf = math.nan, math.inf
    rows += [(None, [0.1] * 20, 1), (50, None, 1), (100, [0.1, None], 1), (150, [nan] * 20, 1), (200, [-inf, 0.0], 2), (250, [0.2] * 20, None), (300, [1e30, -1e30], 3), (350, [0.0] * 20, 3)]
    return [(*r, 1, "x", "m", 2, "p", "q", "s", "t") for r in rows]


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def test_hard_negatives_of_odd_rows(spark, made):
    common.ship_package(spark)
    df = spark.createDataFrame(made, SCHEMA).repartition(4)
    expected = want(made)
    assert len(expected) > 100
    assert result(hard.mined(df)) == expected
    assert result(hard.mined(df, row_block=50, anchor_block=7)) == expected
    assert result(hard.mined(df.limit(0))) == []


def test_given_embeddings(spark, data):
    df = common.table(spark, data, "embeddings")
    assert result(hard.mined(df)) == want([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_bounds_hold_and_leave_out(spark, data):
    df = hard.integer_vectors(common.table(spark, data, "embeddings"))
    rows = hard.block(pa.Table.from_pandas(hard.summarised(df, (df.vec_id % 50) == 0, "summaries").toPandas()))
    anchors = rows.take(rows.vec_id % 50 == 0)
    scores = anchors.vectors @ rows.vectors.T
    width = []
    for level in range(len(hard.LEVELS)):
        low, high = hard.bounds(anchors, rows, level)
        assert ((low - 0.5 <= scores) & (scores <= high + 0.5)).all()
        i, j = np.nonzero(np.ones_like(scores))
        pairs = hard.bounds(anchors, rows, level, i, j)
        assert np.allclose(pairs[0], low.ravel()) and np.allclose(pairs[1], high.ravel())
        width.append((high - low).mean())
    assert width[0] > width[1] > width[2]
