"""The main library without the corpus operators: it still imports, and registers its own queries."""

import pathlib
import shutil
import subprocess
import sys


def test_rest_stands_without_corpus_operators(tmp_path):
    root = pathlib.Path(__file__).parents[2]
    shutil.copytree(root / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split(maxsplit=1)[1].strip() == "[]" and int(said.stdout.split()[0]) >= 80, said.stderr
