"""The learners against plain versions: nearest centroids, and sequential covering over the rows themselves."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from sensorlens.llm import common, language_id, quality_rules


def _plain_grams(text):
    words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    raw = (" " + " ".join(words.encode().decode("utf-8").split(" ")) + " ").encode()
    raw = b" " + b" ".join(raw.split()) + b" "
    out = Counter()
    for k in range(len(raw) - 2):
        h = (raw[k] * 0x9E3779B1 + raw[k + 1] * 0x85EBCA77 + raw[k + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
        h ^= h >> 15
        out[((h * 0x27D4EB2F) & 0xFFFFFFFF) >> 19] += 1
    return out


def test_grams_of_long_texts_are_those_of_the_whole():
    text = "Größe été mañana 日本語 x1y " * 70_000  # several parts, cut inside words and letters
    where, counts = language_id.gram_counts(text)
    assert dict(zip(where.tolist(), counts.tolist())) == dict(_plain_grams(text))
    assert [len(x) for x in language_id.gram_counts("")] == [0, 0]


def test_language_is_that_of_the_nearest_centroid(spark, data):
    docs = common.table(spark, data, "documents")
    common.ship_package(spark)
    model = language_id.fit(docs)
    assert len(model.languages) == len(model.centroids) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    for r in docs.collect():
        text = r.text or ""
        lang, score, rejected = model.predict(r.text)
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0) and rejected
            continue
        vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in _plain_grams(text).items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(float(c[k]) * v for k, v in vector.items()) / length if length else 0.0 for c in model.centroids]
        best = max(cosines)
        assert score == pytest.approx(min(1, max(0, best)), abs=1e-4)
        assert lang in {language for language, c in zip(model.languages, cosines, strict=True) if c > best - 1e-4}
        assert rejected == (score < model.least[[k for k, c in enumerate(cosines) if c > best - 1e-6][0]]) or abs(score - min(model.least)) < 1e-3


def _covering(rows, cuts, most_rules=8, most_conditions=3, least_precision=0.95, least_cover=5):
    """Rules by scanning the rows for each step. ``rows``: (features, bad, fold)."""
    holds = lambda x, c: x[c[0]] > c[2] if c[1] else x[c[0]] <= c[2]
    left, rules = list(rows), []
    while len(rules) < most_rules:
        rule, grown = (), [r for r in left if r[2] == 0]
        while len(rule) < most_conditions:
            p0, n0 = sum(r[1] for r in grown), sum(1 - r[1] for r in grown)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in sorted(quality_rules.FEATURES):
                for t in cuts[f]:
                    for above in (True, False):
                        hit = [r for r in grown if holds(r[0], (f, above, t))]
                        a, b = sum(r[1] for r in hit), sum(1 - r[1] for r in hit)
                        if a >= least_cover:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, t))
            if best[1] is None:
                break
            rule += (best[1],)
            grown = [r for r in grown if holds(r[0], best[1])]
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            hit = [r for r in left if r[2] == 1 and all(holds(r[0], c) for c in rule[:k])]
            p, n = sum(r[1] for r in hit), sum(1 - r[1] for r in hit)
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        _, k, p, n = max(worth)
        rule = rule[:-k]
        if p < least_cover or p / (p + n) < least_precision:
            break
        rules.append(rule)
        left = [r for r in left if not all(holds(r[0], c) for c in rule)]
    return rules


def test_rules_are_those_of_plain_sequential_covering(spark):
    draw = random.Random(9)
    rows = []
    for k in range(600):
        kind = draw.choice(["good", "good", "good", "signs", "copies", "short"])
        n = draw.randint(60, 200)
        words = [f"w{draw.randint(0, 400)}" for _ in range(n)]
        if kind == "signs":
            words = [w + ("$" * draw.randint(1, 3) if draw.random() < 0.7 else "") for w in words]
        elif kind == "copies":
            words = (words[:9] * n)[:n]
        elif kind == "short":
            words = words[: draw.randint(1, 40)]
        rows.append((k, " ".join(words), int((kind == "good") != (draw.random() < 0.01))))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    statistics = quality_rules.text_statistics(df, ["doc_id"])
    got = quality_rules.learn_rules(statistics, labels)
    names = list(quality_rules.FEATURES)
    fold = (quality_rules.F.pmod(quality_rules.F.xxhash64("doc_id"), quality_rules.F.lit(3)) == 0).cast("int")
    table = statistics.join(labels, "doc_id").withColumn("bad", 1 - quality_rules.F.col("quality"))
    cuts = quality_rules.candidate_cuts(table, 24)
    plain = [({f: r[f"x_{f}"] for f in names}, r["bad"], r["fold"]) for r in table.select(*(quality_rules.FEATURES[f]().alias(f"x_{f}") for f in names), "bad", fold.alias("fold")).collect()]
    want = _covering(plain, cuts)
    assert want and [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in got] == want
