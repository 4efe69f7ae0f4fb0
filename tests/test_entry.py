import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["a", "b", "cos"]
    assert df.count() >= 0


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_the_training_data_subpackage(tmp_path, pipeline_stays):
    """On a copy of the repository without the subpackage and its tests; the pipeline's file may be left behind."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or (n == "llm" and Path(folder).name in ("gregale", "tests"))])
    assert not (copy / "gregale/llm").exists() and not (copy / "tests/llm").exists()
    if not pipeline_stays:
        (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not any(k == 'pipeline' or k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, check=True, stdout=subprocess.DEVNULL)


def test_nothing_else_imports_it():
    for path in (ROOT / "gregale").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gregale.llm" not in path.read_text()
