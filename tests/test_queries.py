"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import same  # noqa: E402

from sensorlens.operators import train  # noqa: E402
from sensorlens.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows(spark, duck, data, name):
    same(registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name, monkeypatch):
    # Few rounds, to save time; test_model_sizes holds the queries to their real sizes.
    monkeypatch.setattr(train, "FACTORIES", {k: (lambda n, rounds, f=f: f(n, 5)) for k, f in train.FACTORIES.items()})
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_rest_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).parent.parent
    for keep_pipeline in (False, True):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(root / "sensorlens", copy / "sensorlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if keep_pipeline and (root / "corpus_pipeline.py").exists() else [])]:
            shutil.copy(root / name, copy / name)
        code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries()); assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
        subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)
