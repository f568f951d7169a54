"""The driver's entry, with and without the text operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

from tidewatch.plans.catalog import QUERIES
from tidewatch.plans.oracle import ORACLE

REPO = Path(__file__).resolve().parents[1]


def test_entry_without_the_text_operators(tmp_path):
    """A copy of the library without its text folders still names every other query."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(REPO / "tidewatch", tmp_path / "tidewatch", ignore=skip)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    named, sql = json.loads(done.stdout)
    assert named == sorted(QUERIES) and sql == sorted(ORACLE)


def test_every_query_of_the_library_is_named():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
