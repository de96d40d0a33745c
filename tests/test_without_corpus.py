"""The engine stands without the corpus subpackage and its pipeline."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_corpus(tmp_path):
    shutil.copytree(ROOT / "clustrum", tmp_path / "clustrum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'silhouette' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_corpus():
    for p in (ROOT / "clustrum").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*llm", p.read_text(), re.M), p


def test_engine_queries_where_a_library_is_missing():
    """A corpus operator's library that can't be imported takes no query of the engine with it."""
    code = "import sys; sys.modules['ahocorasick'] = sys.modules['sentencepiece'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'silhouette' in q and set(s) <= set(q) and 'op6_sentencepiece' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
