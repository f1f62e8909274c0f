"""Every catalog query against its DuckDB oracle on sf0.01 (the driver's
correctness gate), plus the entry-point contract."""

import os

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE, SF_SMALL
from tools.oracle_check import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_ORACLE), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["combined_section", "total_quantity", "total_value"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    # The optional training-data queries have tests of their own.
    missing = set(entry.queries()) - set(entry.LLM_QUERIES) - set(entry.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_ORACLE)
    assert res["status"] in ("ok", "no-oracle"), res


def test_queries_run_on_smallest_tables(spark):
    for name in ["inventory_summary", "upsert_items", "apply_quantity_events", "phone_merge"]:
        entry.queries()[name](spark, SF_SMALL).count()


def test_entry_module_from_another_directory(tmp_path):
    """The driver loads __spark_entry__.py by path from elsewhere: Python
    workers must not need the package on their path (functions travel by
    value)."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(repo, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", m.queries()["price_distinct"](spark, {SF_SMALL!r}).count(), m.entry(spark).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows " in out.stdout


def test_only_the_pluggable_price_function_runs_python(spark):
    """Stay JVM-side: no registered query has a Python stage in its plan
    except the per-distinct-key price function (J3/F3)."""
    import re
    python_stage = re.compile(r"MapInPandas|ArrowEvalPython|BatchEvalPython|PythonMapInArrow|FlatMapGroupsInPandas")
    catalog = {n: f for n, f in entry.queries().items() if n not in entry.LLM_QUERIES}
    with_python = {name for name, fn in catalog.items()
                   if python_stage.search(fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString())}
    assert with_python == {"price_distinct"}


def test_queries_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    for name in ["row_id", "anonymise", "running_quantity", "apply_quantity_events", "flatten_sections",
                 "upsert_items", "inventory_maintenance", "explore_phones", "stream_apply_events"]:
        entry.queries()[name](spark, SF_SMALL).count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_null_safe_merge_shares_the_left_exchange(spark):
    """Without broadcasts: one exchange of the left rows, one of the right
    rows, and one of the distinct right keys (combined map-side)."""
    import re
    from stockroom.operators import left_join_nullsafe
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.createDataFrame([(str(i % 7) if i % 5 else None, i) for i in range(100)], "k string, i int")
        right = spark.createDataFrame([(str(j) if j else None, j) for j in range(5)], "k string, j int")
        out = left_join_nullsafe(left, right, "k")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert len(re.findall(r"\+- Exchange hashpartitioning", final)) == 3, final
        assert "ReusedExchange" in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bench_prints_one_json_line(tmp_path):
    import json
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "BENCH_SF_DIR": SF_SMALL, "BENCH_REPEATS": "1", "BENCH_CPUS": "2"}
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py"), "inventory_summary", "group_total"],
                         cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and set(d["queries"]) == {"inventory_summary", "group_total"}
    assert d["value"] == round(sum(d["queries"].values()), 3) and d["sf"] == "0.001"
