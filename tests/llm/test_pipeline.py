"""The pipeline's stages, each on its own input, against plain rules."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
from test_near_copies import _groups, _sets  # noqa: E402

from sensorlens.llm import common, language_id, mixing, quality_rules  # noqa: E402


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    labels = common.table(spark, data, "labels")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "mixing", "packing"]

    def kept(name, given):
        if name == "quality_rules":
            return Counter(r.doc_id for r in quality_rules.judged(given, labels).where("kept").collect())
        if name == "language_id":
            return Counter(r.doc_id for r in language_id.identified(given).where("not rejected").collect())
        if name == "simhash_near_dedup":
            source = sorted((r.doc_id, r.text) for r in given.collect())
            return Counter({source[g][0] for g in _groups(_sets([t for _, t in source]))})
        taken = mixing.mixed(given).where("taken > 0").collect()
        return Counter({r.doc_id: r.taken // r.size for r in taken})

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settled(stage(spark, docs, data), name)
        assert out.columns == columns
        assert Counter(r.doc_id for r in out.collect()) == kept(name, docs)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    ends = Counter(r.doc_id for r in packed if r.start + r.length == r.doc_tokens)
    assert ends == Counter(r.doc_id for r in docs.collect())
