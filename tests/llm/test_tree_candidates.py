"""The SimHash tree of the pipeline's near-duplicate stage: its candidates, and what they are worth."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_near_copies import _groups, _sets  # noqa: E402

from sensorlens.llm import common, shingles, simhash  # noqa: E402


def _texts():
    """Texts with copies in which one word, or two, or a tenth of them is another."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(2000)]
    out = ["", "one two"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(150, 250))
        out.append(base)
        for n in (1, 2, len(base) // 10):
            c = list(base)
            for at in rng.sample(range(len(c)), n):
                c[at] = "changed"
            out.append(c)
    return [t if isinstance(t, str) else " ".join(t) for t in out]


def _parts(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    parts = {}
    for n in nodes:
        parts.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, parts.values()))


def test_candidates_hang_together_as_fingerprints_do(spark):
    common.ship_package(spark)
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = shingles.with_digests(df).select("row.text", "digest", "fp").collect()
    fps = {r.digest: simhash.fingerprint(r.text, 1) for r in made}
    assert {r.digest: r.fp & (1 << 64) - 1 for r in made} == fps
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.LINK_BITS]
    got = [tuple(r) for r in simhash.tree_pairs(spark.createDataFrame([(r.digest, r.fp) for r in made], "digest long, fp long")).collect()]
    assert all(a < b for a, b in got) and len(set(got)) == len(got)
    assert _parts(got, fps) == _parts(near, fps) and len(_parts(got, fps)) < len(fps)


def test_tree_finds_near_copies_without_shingles(spark, monkeypatch):
    """With what the tree alone finds, most copies go, and none that all pairs wouldn't drop."""
    common.ship_package(spark)
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stay = set(_groups(_sets(texts)))
    with monkeypatch.context() as patch:
        patch.setattr(simhash, "set_groups", lambda rows, candidates, components: components(shingles.verified(candidates, rows.select("digest", "text"), 8)))
        kept = {r.doc_id for r in simhash.keep_one_of_each(df).collect()}
    assert stay <= kept and len(texts) - len(kept) > 0.6 * (len(texts) - len(stay))
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == stay


def test_groups_are_the_same_for_any_candidates(spark, monkeypatch):
    common.ship_package(spark)
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stay = sorted(set(_groups(_sets(texts))))
    star = lambda marks: common.settled(marks.crossJoin(marks.selectExpr("min(digest) as a")).selectExpr("a", "digest as b").where("a <> b"), "pairs")
    for made in (star, lambda marks: star(marks).limit(0)):
        monkeypatch.setattr(simhash, "tree_pairs", made)
        assert sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect()) == stay
