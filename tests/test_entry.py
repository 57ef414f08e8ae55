"""The entry point without the subpackage that it may lack."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def listed(folder):
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


def test_queries_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    n, sqls, optional = listed(copy)
    assert int(n) > 40 and int(sqls) > 40 and optional == "False"
    (copy / "corpus_pipeline.py").unlink()
    assert listed(copy) == [n, sqls, "False"]
