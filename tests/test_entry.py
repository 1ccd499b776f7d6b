"""The entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _listed(folder: str) -> tuple[set, set]:
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, timeout=300).stdout.splitlines()
    return set(out[0].split()), set(out[1].split())


def test_rest_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "ledgerlake"), tmp_path / "ledgerlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    queries, sql = _listed(str(tmp_path))
    assert "c01_manifest_diff" in queries and sql <= queries
    assert not any(q == "pipeline" or q.startswith("op") and q[2].isdigit() for q in queries)


def test_every_sql_belongs_to_a_query():
    queries, sql = _listed(ROOT)
    assert sql <= queries and "c01_manifest_diff" in sql
