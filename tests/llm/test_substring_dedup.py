"""Substring dedup against plain windows, and what recompression promises: equal windows have equal marks."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorlens.llm import common, recompression as rec, substring_dedup as dedup

SCHEMA = "doc_id long, text string, key long, mark string, whole string, wholes string, masks string, kept string, first string"


def want(rows, width):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, words in split:
        for k in range(len(words) - width + 1):
            if d is not None:
                w = tuple(words[k : k + width])
                least[w] = min(d, least.get(w, d))
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if d is not None and least[tuple(words[k : k + width])] < d:
                gone |= set(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(12)
    word = lambda n: f"w{draw.randrange(n)}"
    passages = [[word(60) for _ in range(draw.randrange(20, 90))] for _ in range(12)]
    passages += [["a"] * 70, ["a", "b"] * 45, ["a", "b", "c"] * 30, ["é"] * 51, ["x"] * 49]
    rows = []
    for k in range(150):
        words = []
        for _ in range(draw.randrange(1, 6)):
            some = draw.choice(passages)
            cut = draw.randrange(len(some)) if draw.random() < 0.4 else 0
            words += some[cut:] + [word(3000) for _ in range(draw.randrange(0, 30))]
        rows.append((draw.choice([k, k, k // 3, None]), draw.choice([" ", "\n", "\t "]).join(words)))
    rows += [rows[7], rows[7], (3, None), (4, ""), (5, " \n"), (None, None), (200, "z " * 700), (201, "z " * 900 + "y"), (202, "y\x1cq " * 60), (203, "y\x1cq " * 55)]
    return rows


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=repr)


@pytest.mark.parametrize("width", [50, 20, 64])
def test_odd_documents(spark, made, width):
    common.ship_package(spark)
    df = spark.createDataFrame([(*r, 5, *"abcdef") for r in made], SCHEMA).repartition(5)
    expected = want(made, width)
    assert sum(r[2] for r in expected) > 1000
    assert result(dedup.without_repeats(df, width)) == expected
    assert result(dedup.without_repeats(df.limit(0), width)) == []


def test_removed_spans(spark, made):
    df = spark.createDataFrame([(*r, 5, *"abcdef") for r in made], SCHEMA)
    for r in dedup.without_repeats(df).collect():
        assert sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed and r.n_words - r.n_removed == len(r.kept.split(" ") if r.kept else [])
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.removed, r.removed[1:]))


def test_equal_windows_have_equal_marks():
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(4)}" for _ in range(400)) for _ in range(20)] + ["a b " * 200, "a " * 300, "b a " * 100 + "c " * 120]
    shared = " ".join(f"s{draw.randrange(50)}" for _ in range(80))
    texts += [f"{t} {shared} {u}" for t, u in zip(texts, reversed(texts))]
    words = rec.words_of(pa.array(texts))
    p = rec.parsed(words, 50)
    marks = {}
    for window, level, name, start in zip(*(x.tolist() for x in p)):
        assert window <= start < window + 50
        mark = (level, name, start - window)
        assert marks.setdefault(tuple(words.names[window : window + 50].tolist()), mark) == mark
    assert len(p.window) == sum(max(0, len(t.split()) - 49) for t in texts)


def test_pieces_have_each_window_once():
    draw = random.Random(3)
    texts = pa.array([None, "", "one", *(" ".join(f"w{draw.randrange(9)}" for _ in range(n)) for n in (49, 50, 51, 400, 1000))])
    whole = rec.stretches(rec.words_of(texts), 50)
    found = []
    for words, docs, firsts in rec.pieces(texts, 50, most=90):
        p = rec.parsed(words, 50)
        at = np.searchsorted(words.before, p.window, side="right") - 1
        found += zip(docs[at].tolist(), (p.window - words.before[at] + firsts[at]).tolist(), p.name.tolist())
    all_words = rec.words_of(texts)
    p = rec.parsed(all_words, 50)
    at = np.searchsorted(all_words.before, p.window, side="right") - 1
    assert sorted(found) == sorted(zip(at.tolist(), (p.window - all_words.before[at]).tolist(), p.name.tolist()))
    assert whole.windows.sum() == len(p.window)
