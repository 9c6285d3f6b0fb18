"""The entry module without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def run_in(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)


def whole_copy(tmp_path):
    folder = tmp_path / "repo"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns("__pycache__", ".git", ".pytest_cache"))
    return folder


CHECK = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_rest_works_without_the_optional_parts(tmp_path, pipeline_stays):
    folder = whole_copy(tmp_path)
    for part in ("earshot/llm", "tests/llm"):
        shutil.rmtree(folder / part, ignore_errors=True)
    if not pipeline_stays:
        (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    done = run_in(folder, CHECK)
    assert done.returncode == 0, done.stderr


def test_other_import_errors_are_not_swallowed(tmp_path):
    folder = whole_copy(tmp_path)
    (folder / "earshot" / "llm").mkdir(exist_ok=True)
    (folder / "earshot" / "llm" / "__init__.py").touch()
    (folder / "earshot" / "llm" / "queries.py").write_text("import no_such_module")
    done = run_in(folder, "import __spark_entry__ as e; e.queries()")
    assert "no_such_module" in done.stderr
