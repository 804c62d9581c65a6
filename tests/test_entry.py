"""The driver entry with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "lumenframe", tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def _run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"})


def test_without_the_subpackage(copy):
    r = _run(copy, "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    assert r.returncode == 0, r.stderr
    n, training, fits = r.stdout.split()
    assert int(n) > 90 and training == "0" and fits == "True"


def test_an_error_inside_the_subpackage_is_not_hidden(copy):
    (copy / "lumenframe" / "llm").mkdir()
    (copy / "lumenframe" / "llm" / "__init__.py").write_text("")
    (copy / "lumenframe" / "llm" / "queries.py").write_text("import lumenframe.llm.misspelt\n")
    r = _run(copy, "import __spark_entry__")
    assert r.returncode != 0 and "misspelt" in r.stderr
