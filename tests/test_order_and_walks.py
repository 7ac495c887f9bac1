"""Exact quantiles and balanced buckets on odd numbers, and walks over text against plain loops."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlens.functions import text as T, walks
from sensorlens.operators import corpus, quantiles, ranks

INF = math.inf


def columns():
    draw = random.Random(9)
    return {
        "one": [5.0], "two": [1.0, 2.0], "constant": [3.0] * 700, "ties": [float(draw.randrange(4)) for _ in range(999)], "infinite": [INF] * 5 + [-INF] * 4 + [1.0, 2.0], "all_infinite": [INF] * 9,
        "outlier": [draw.random() for _ in range(2000)] + [1e300], "wide": [10 ** draw.uniform(-300, 300) for _ in range(1500)], "negative": [-draw.expovariate(1) for _ in range(800)], "zeros": [0.0, -0.0, 0.0, 1.0],
        None: [draw.gauss(0, 1) for _ in range(50)],
    }


def test_exact_quantiles(spark):
    given = columns()
    rows = [(k, v) for k, values in given.items() for v in values] + [("one", None), ("nothing", None), ("nan", math.nan), ("two", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: (r.median, r.p90, r.least, r.greatest) for r in quantiles.exact_quantiles(df, "v", ["k"], {"median": 0.5, "p90": 0.9, "least": 0.0, "greatest": 1.0}).collect()}
    assert set(got) == set(given)
    for k, values in given.items():
        s = sorted(values)
        for share, value in zip((0.5, 0.9, 0.0, 1.0), got[k]):
            at = share * (len(s) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            assert value == a if a == b else value == pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12), (k, share)
    assert quantiles.exact_quantiles(df.where("k = 'ties'"), "v", [], {"m": 0.5}).first().m == float(np.median(given["ties"]))
    assert quantiles.exact_quantiles(df.limit(0), "v", ["k"], {"m": 0.5}).collect() == []


def test_buckets_are_even_whatever_the_spread(spark):
    draw = random.Random(3)
    values = [draw.random() for _ in range(40_000)] + [1e9, -1e12, INF]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = df.groupBy(quantiles.balanced_buckets(df, "v", 64).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
    assert max(r.n for r in counts) <= 2 * len(values) / 64
    assert all(a.high < b.low for a, b in zip(counts, counts[1:]))
    ranked = ranks.running(df, [], ranks.by_size(df, "v"), [F.col("v")], {"place": None}).collect()
    assert [r.v for r in sorted(ranked, key=lambda r: r.place)] == sorted(values)


def plain_erased(text):
    out = []
    for c in text:
        if c != "\b":
            out.append(c)
        elif out:
            out.pop()
    return "".join(out)


def plain_inside(text):
    out, at = [], 0
    while (at := text.find("$(", at)) >= 0:
        depth, end = 1, at + 2
        while end < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if depth:
            break
        out.append(text[at + 2 : end - 1])
        at = end
    return out


def plain_common(x, y):
    row = [0] * (len(y) + 1)
    for w in x:
        left = 0
        for j, v in enumerate(y, 1):
            left, row[j] = row[j], left + 1 if w == v else max(row[j], row[j - 1])
    return row[-1]


def test_walks_agree_with_loops(spark):
    draw = random.Random(7)
    for _ in range(3000):
        text = "".join(draw.choice("ab\b\b\bé\U0001f600") for _ in range(draw.randrange(20)))
        assert walks.erased(text) == plain_erased(text)
        text = "".join(draw.choice("()$$()(a é") for _ in range(draw.randrange(25)))
        assert walks.substituted(text) == plain_inside(text)
        x, y = ([draw.choice("abcd") for _ in range(draw.randrange(90))] for _ in range(2))
        assert walks.common(x, y) == plain_common(x, y)
    texts = ["ab\bc", None, "", "\b\b", "plain", "é\b\bx"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.backspaced(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [None if t is None else plain_erased(t) for t in texts]
    df = spark.createDataFrame([("x $(a (b) $(c)) $(d; e) $(f",), (None,), ("none",)], "command string")
    assert [r.inner for r in corpus.inner_commands(df).collect()] == [["a (b) $(c)", "d"], [], []]


def test_walks_take_linear_time():
    began = time.perf_counter()
    assert len(walks.erased("abc\b" * 250_000)) == 500_000
    assert len(walks.substituted("$(a (b) c) " * 90_000)) == 90_000
    assert time.perf_counter() - began < 2
    x, y = ([f"w{random.Random(s).randrange(50)}{k % 97}" for k in range(2000)] for s in (1, 2))
    began = time.perf_counter()
    walks.common(x, y)
    assert time.perf_counter() - began < 0.1
