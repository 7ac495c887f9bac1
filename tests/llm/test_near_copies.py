"""The pipeline's near-duplicate stage against all pairs: five-word shingles, Jaccard of 0.8 or more."""

from __future__ import annotations

import random

import pytest

from sensorlens.llm import common, simhash


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def _groups(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def _texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    out = [None, "", " \n", "one two", "One  Two", "one two three"]
    out += [" ".join(rng.choices(words, k=rng.randint(6, 150))) for _ in range(60)]
    for t in out[6:26]:  # copies with a few words changed, at every similarity around 0.8
        w = t.split()
        for k in range(1, 5):
            c = list(w)
            for at in rng.sample(range(len(c)), min(k, len(c))):
                c[at] = "changed"
            out.append(" ".join(c))
    base = rng.choices(words, k=120)  # a crowd that meets in the same shingles
    for k in range(150):
        c = list(base)
        for at in rng.sample(range(len(c)), rng.randint(1, 5)):
            c[at] = f"x{k}"
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"sample_size": 40, "listed": 10}])
def test_stage_keeps_one_of_each_group(spark, options):
    common.ship_package(spark)
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = simhash.keep_one_of_each(df, **options)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(_groups(_sets(texts))))


def test_long_texts_in_parts(spark):
    """Sets around each border between numbers of parts, changed, cut and lengthened to similarities around 0.8."""
    common.ship_package(spark)
    rng, words, texts = random.Random(6), [f"w{k}" for k in range(400)], []
    for n in (200, 250, 259, 300, 400, 512, 530, 700, 1030, 1500):
        base = rng.choices(words, k=n)
        texts.append(base)
        for share in (0.01, 0.018, 0.022, 0.024, 0.03):
            c = list(base)
            for at in rng.sample(range(n), int(share * n)):
                c[at] = "changed"
            texts.append(c)
        texts += [base[: int(n * 0.801)], base[int(n * 0.21) :], base + rng.choices(words, k=int(n * 0.24)), base + rng.choices(words, k=int(n * 0.27))]
    texts = [" ".join(t) for t in texts]
    groups = _groups(_sets(texts))
    assert 20 < len(set(groups)) < 90
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for options in ({}, {"block": 5, "listed": 50}):
        assert sorted(r.doc_id for r in simhash.keep_one_of_each(df, **options).collect()) == sorted(set(groups))


def test_all_columns_come_back(spark):
    common.ship_package(spark)
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, "other words", 9, "z")], "doc_id long, text string, _near_row long, digest string")
    df = df.withColumns({c: df._near_row for c in ("near", "row", "size", "_near_digest", "root", "a.b")})
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.near for r in kept.collect()) == [7, 9]


def test_stage_on_documents(spark, data):
    common.ship_package(spark)
    docs = common.table(spark, data, "documents")
    source = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {source[g][0] for g in _groups(_sets([t for _, t in source]))}
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == want


def test_rows_go_not_ids(spark):
    common.ship_package(spark)
    rows = [(1, "one text of some seven words here"), (2, "one text of some seven words here"), (2, "quite another text that nothing else is like"), (3, "quite another text that nothing else is like")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]


def test_links_through_trees_of_full_shards(spark):
    """Shards with trees of their own, in one piece and in several, and crowded ones give the links of all pairs."""
    import numpy as np

    common.ship_package(spark)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = set(rng.integers(0, 1 << 63, 1500, np.uint64).tolist())
    for c in centres.tolist():  # crowds within a few bits of each other
        for _ in range(60):
            x = c
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            fps.add(x)
    x = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= simhash.LINK_BITS
    label = np.arange(len(x))
    while True:
        least = np.where(near, label[None, :], len(x)).min(1)
        least = np.minimum(label, least[least])
        if (least == label).all():
            break
        label = least
    groups = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(4)
    want = {}
    for v, k in zip(x.view(np.int64).tolist(), label.tolist()):
        want.setdefault(k, set()).add(v)
    want = sorted(sorted(s) for s in want.values() if len(s) > 1)
    for dense, piece in ((100, None), (30, 20)):
        with pytest.MonkeyPatch.context() as patch:
            if piece:
                parted = simhash._parted
                patch.setattr(simhash, "_parted", lambda a, b, c: parted(a, b, c, piece))
            found = simhash.components(simhash.fingerprint_links(groups, sample_size=800, shard_size=400, dense=dense, leaves=8)).collect()
        got = {}
        for r in found:
            got.setdefault(r.root, set()).add(r.node)
        assert sorted(sorted(s) for s in got.values()) == want and len(want) > 20
