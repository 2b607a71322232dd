import os
import shutil
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, difference  # noqa: E402

from workload import oracle, spark_queries  # noqa: E402

QUERIES = spark_queries.queries()
ORACLES = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])) == ""


def test_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    for at, kept in enumerate((left_out, shutil.ignore_patterns("llm", ".git", "__pycache__"))):
        shutil.copytree(root, tmp_path / str(at), ignore=kept)
        code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) == set(e.queries())"
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / str(at), capture_output=True, text=True)
        assert said.stdout.split() == sorted(QUERIES), said.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0
