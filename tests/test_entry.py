"""The contract file with and without the operators for training data."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names, sql = done.stdout.splitlines()
    return set(names.split()), set(sql.split())


@pytest.mark.parametrize("without", [["shipledger/llm", "tests/llm"], ["shipledger/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_listed_without_parts(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[w.rpartition("/")[2] for w in without if w != "tests/llm"]))
    assert not any((copy / w).exists() for w in without)
    names, sql = listed(copy)
    assert sql <= names and "pipeline" not in names and "compare_summary" in names
    assert any(n.startswith("op") and n[2].isdigit() for n in names) == ((copy / "shipledger/llm").exists())


def test_every_sql_has_its_query():
    names, sql = listed(ROOT)
    assert sql <= names
