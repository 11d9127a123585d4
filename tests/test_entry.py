"""The entry module without the optional operators, or without what they need."""

from __future__ import annotations

import subprocess
import sys

import pytest
from conftest import ROOT

SCRIPT = """
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "game_sessions" in names and names == set(entry.oracle_sql())
assert not any(name.startswith("op") or name == "pipeline" for name in names)
"""


@pytest.mark.parametrize("missing", ["playlens.llm", "xxhash", "tokenizers", "corpus_pipeline"])
def test_other_queries_are_registered(missing):
    run = subprocess.run([sys.executable, "-B", "-c", SCRIPT.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
