"""The driver's contract, with and without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("left_out", [("strideframe/llm", "tests/llm", "corpus_pipeline.py"), ("strideframe/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_of_a_smaller_copy(tmp_path, left_out):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    for name in left_out:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    count, has_llm = done.stdout.split()[-2:]
    assert int(count) > 100 and has_llm == str((copy / "strideframe/llm").exists())
