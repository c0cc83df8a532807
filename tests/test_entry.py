"""The driver's contract, with the corpus operators and without them."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT

_ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"


def _asked(folder):
    run = subprocess.run([sys.executable, "-B", "-c", _ASK], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert run.returncode == 0, run.stderr
    return tuple(map(int, run.stdout.split()[-2:]))


def test_entry_imports_with_and_without_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".*")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    queries, oracles = _asked(tmp_path / "repo")
    assert queries > 100 and oracles > 100
    assert _asked(ROOT)[0] >= queries


def test_a_broken_dependency_is_not_taken_for_a_missing_folder(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "corpusmill", "llm")):
        return
    (tmp_path / "public_tokenizers.py").write_text("import no_such_module_at_all\n")
    run = subprocess.run([sys.executable, "-B", "-c", _ASK], cwd=ROOT, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"})
    assert run.returncode != 0 and "no_such_module_at_all" in run.stderr


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_only_the_entry_swallows_import_errors():
    for folder, _, names in os.walk(os.path.join(ROOT, "corpusmill")):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as source:
                    assert "except ImportError" not in source.read(), name
