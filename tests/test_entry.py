"""The query registry."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert queries and set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())


@pytest.mark.parametrize("gone", [("boxfield/llm",), ("boxfield/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_text_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "boxfield"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name) if (tmp_path / name).is_dir() else (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'support_fraction' in q and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120).returncode == 0
