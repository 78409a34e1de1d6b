"""The entry point in a copy of the repository without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
print(e.__file__.startswith(sys.argv[1]), len(e.queries()), len(e.oracle_sql()), "pipeline" in e.queries(), sum(q.startswith("op") for q in e.queries()))
"""


@pytest.mark.parametrize("gone", [("webframe/llm", "tests/llm"), ("webframe/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_subpackage(tmp_path, gone):
    skip = {os.path.join(ROOT, name) for name in gone}

    def left_out(folder, names):
        return [n for n in names if os.path.join(folder, n) in skip or n in (".git", "__pycache__", ".pytest_cache")]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "copy")], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
    own, queries, oracles, pipeline, llm = done.stdout.split()
    assert (own, pipeline, llm) == ("True", "False", "0")
    assert int(queries) >= 73 and int(oracles) >= 73
