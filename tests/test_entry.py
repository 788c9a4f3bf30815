"""The entry without what the corpus operators need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("absent", ["furrow.llm", "corpus_pipeline", "public_tokenizers"])
def test_core_queries_stay_when_a_module_is_absent(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'nms_per_frame' in q and {{*e.oracle_sql()}} <= {{*q}}; assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
