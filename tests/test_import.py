"""The library without the add-on operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    for also in ("corpus_pipeline.py", None):  # with the pipeline file still there, then without it
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, capture_output=True)
        if also:
            (tmp_path / "copy" / also).unlink(missing_ok=True)


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "parley").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "parley.llm" not in path.read_text(encoding="utf-8"), path
