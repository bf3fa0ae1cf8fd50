"""Every query against its SQL on the smallest tables."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from check import compare, database

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    message = compare(spark, con, name, SF)[2]
    assert message.startswith("ok"), message


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries() and "eval_summary" in entry.queries()


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["tp"] > 0


def test_entry_works_without_the_text_operators(tmp_path):
    """The subpackage, its tests and the pipeline can be taken away."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__")])
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    own = [q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q)]
    assert done.stdout.split() == [str(len(own)), "False"], done.stderr[-2000:]
