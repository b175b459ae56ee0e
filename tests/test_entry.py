"""The entry module without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
assert "T1_select_topk" in e.queries() and "pipeline" not in e.queries()
assert not [q for q in e.queries() if q.startswith("op")]
print("entry fine")
"""


def test_without_the_corpus_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "graftwork", tmp_path / "graftwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "graftwork" / "llm" / "__pycache__").mkdir(parents=True)
    run = subprocess.run([sys.executable, "-B", "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert "entry fine" in run.stdout, run.stderr[-2000:]
