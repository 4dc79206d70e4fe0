"""The driver contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "k", "score"]


def test_imports_without_the_subpackage(tmp_path):
    for f in ROOT.rglob("*.py"):
        rel = f.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score_high' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
