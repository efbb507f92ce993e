"""The entry point with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    run = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True)
    queries, oracles = (line.split() for line in run.stdout.strip().split("\n"))
    return set(queries), set(oracles)


def test_the_rest_stands_alone(tmp_path):
    """With both folders of the package deleted, the pipeline's module with them or left behind."""
    shutil.copytree(ROOT / "pagecorpus", tmp_path / "pagecorpus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    bare, oracles = listed(tmp_path)
    assert bare == oracles and len(bare) >= 90 and not any(n.startswith("op") and n[2:3].isdigit() for n in bare)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    assert listed(tmp_path)[0] == bare
    whole, _ = listed(ROOT)
    assert bare <= whole
