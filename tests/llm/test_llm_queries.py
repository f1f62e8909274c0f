"""Registered training-data queries against their SQL twins; the entry without the subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE
from tools.oracle_check import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_ORACLE), reason="test tables not present")


def test_all_operators_are_registered():
    names = set(entry.LLM_QUERIES)
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_query_matches_sql(spark, name):
    res = compare(spark, duck(SF_ORACLE), name, entry.queries()[name], entry.oracle_sql()[name], SF_ORACLE)
    assert res["status"] == "ok", res


def test_entry_works_without_the_subpackage(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; assert e.LLM_QUERIES == {} and 'inventory_summary' in e.queries()")
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=120)
