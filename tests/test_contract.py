"""The registered queries: names, SQL, and agreement on the smallest tables.

All queries are compared by ``python tests/oracle.py <tables>``; here only the headline ones.
"""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from bench import HEADLINE
from ledgerline import plans
from tests.oracle import difference

TABLES = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    """Of the library's own queries; some corpus operators cannot be put into SQL and are tested otherwise."""
    assert set(plans.QUERIES) == set(plans.ORACLES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(HEADLINE) <= set(contract.queries())


@pytest.mark.parametrize("trace", [False, True])
def test_without_the_corpus_operators(tmp_path, trace):
    """The contract holds without them, also where an empty folder is left."""
    here = Path(contract.__file__).parent
    shutil.copytree(here / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    if trace:
        (tmp_path / "ledgerline" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.stdout.split() == [str(len(plans.QUERIES))] * 2, run.stderr


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", HEADLINE)
def test_agrees_with_sql(spark, name):
    assert difference(spark, contract.queries()[name], contract.oracle_sql()[name], TABLES) is None


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["user_id", "allowed", "denied"] and out.count() > 0
