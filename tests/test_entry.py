"""The registry must be readable before any session exists."""

import subprocess
import sys
from pathlib import Path


def test_registry_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q) >= len(s) > 90, set(s) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr
