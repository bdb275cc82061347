"""The library without the subpackage llm."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 1 + pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "pagewatch", tmp_path / "pagewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys() and len(e.queries()) > 100"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_remaining_tests_pass_without_llm(tmp_path):
    """All of them are collected; of each file that needs no long run, they pass."""
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "pagewatch", tmp_path / "pagewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True)
    collected = run("--collect-only", "tests")
    assert collected.returncode == 0 and "error" not in collected.stdout.lower(), collected.stdout[-2000:]
    done = run("tests/test_entry.py", "tests/test_cases.py")
    assert done.returncode == 0, done.stdout[-3000:]
