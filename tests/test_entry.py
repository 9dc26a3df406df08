"""The driver's entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); import loomframe"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    # its tests can all be collected, and some run
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, check=True, env=env, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_entry.py", "-k", "not without and not broken"], cwd=copy, check=True, env=env, stdout=subprocess.DEVNULL)


def test_a_broken_operator_is_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    with open(copy / "loomframe" / "llm" / "simhash.py", "a") as f:
        f.write("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
