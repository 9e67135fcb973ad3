"""The library works without its optional subpackage, whether or not the pipeline file goes with it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [("abaculus/llm",), ("abaculus/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n_queries, n_sql, optional = out.stdout.split()
    assert int(n_queries) >= 100 and int(n_sql) >= 100 and optional == "False"
