"""Python workers must not need this package on their path."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from graftwork.session import local_session
spark = local_session(2)
for name in ("M4_dare_ties_merge", "W9_magnitude_trim", "J10_task_vectors", "X1_python_template"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("workers fine")
"""


def test_workers_run_away_from_the_repository(tmp_path):
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False
    )
    assert "workers fine" in run.stdout, run.stderr[-3000:]
