"""The entry module, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"


def names(root):
    return subprocess.run([sys.executable, "-c", SAY], cwd=root, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_corpus_operators(tmp_path):
    for name in ("pricelore", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    left = names(tmp_path)
    assert "products" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path) == left
