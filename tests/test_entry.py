"""The entry module without the training-data subpackage, its tests and the pipeline over it."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder: str) -> set[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_subpackage(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    rest = names(str(bare))
    assert "features_33" in rest and "pipeline" not in rest and not any(n.startswith("op") for n in rest)
    if os.path.isdir(f"{ROOT}/kinmark/llm"):
        assert {n for n in names(ROOT) - rest if n.startswith("op") or n == "pipeline"} == names(ROOT) - rest
        assert len(names(ROOT) - rest) == 11
