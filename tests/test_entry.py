"""The repository without the training-data operators still imports and lists all other queries."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tapewright import registry

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q, sum(k.startswith('op') for k in q))"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_without_the_llm_folders(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(registry.queries())), "False", "0"]
