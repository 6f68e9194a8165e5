"""The entry module works when the optional training-data folders are gone, with or without the pipeline module."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data_folders(tmp_path, pipeline):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=gone)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dense_eval' in q and 'pipeline' not in q; assert not any(k.startswith('op') and k[2:3].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
