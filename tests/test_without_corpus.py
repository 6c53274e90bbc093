"""The library and its queries without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
CORPUS = {ROOT / "polymera" / "llm", ROOT / "tests" / "llm", ROOT / "corpus_pipeline.py"}


def _copy(to, without):
    def left_out(folder, names):
        return [n for n in names if Path(folder) / n in without or n in (".git", "__pycache__")]

    shutil.copytree(ROOT, to, ignore=left_out)


def _names(folder):
    said = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", said], cwd=folder, capture_output=True, text=True)
    return done.returncode, [set(line.split()) for line in done.stdout.splitlines()], done.stderr


def test_other_queries_stay(tmp_path):
    from polymera.plans import catalog

    _copy(tmp_path / "cut", CORPUS)
    code, names, _ = _names(tmp_path / "cut")
    assert code == 0 and names == [set(catalog.queries()), set(catalog.oracle_sql())]


def test_an_error_inside_the_corpus_operators_is_not_passed_over(tmp_path):
    _copy(tmp_path / "broken", CORPUS)
    (tmp_path / "broken" / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    code, _, errors = _names(tmp_path / "broken")
    assert code != 0 and "a_module_that_is_not_there" in errors
