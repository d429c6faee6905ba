"""The library without the training-data operators: the entry still imports and gives the other queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_llm_folders(tmp_path, also):
    gone = {"llm", ".git", "__pycache__", ".pytest_cache", *also}
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda folder, names: [n for n in names if n in gone])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_daily' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert done.stdout.strip() == "fine", done.stderr
