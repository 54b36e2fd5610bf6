"""The entry point must import without a running session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr
