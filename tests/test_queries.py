"""Every registered query against its SQL, and properties of all plans."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, connect
from rillway.plans.catalogue import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# Python runs in these plans only: documents of any depth.
PYTHON = {"q_element_sets", "q_spec_complexity", "w_document_report", "q_quality_summary"}
# One row in all, or offsets of partitions, of which there are as many as shuffle partitions.
SINGLE = {"q_quality_summary"} | {
    name for name in QUERIES if name.startswith("q_sort") or name in
    ("q_corpus_blocks", "q_group_sorted", "q_limit", "w_sort_people", "w_count_by_title", "w_active_suppliers")
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_result_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_scales(spark, name):
    # Without broadcasts of small test tables: the plan that large tables would get.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("Python" in plan or "Arrow" in plan) == (name in PYTHON)
    assert ("SinglePartition" in plan) == (name in SINGLE)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["w_sales_by_country_category"](spark, SF_DIR))
    assert "GreaterThan(l_extendedprice,50000.0)" in plan
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert re.search(r"FileScan parquet \[l_orderkey#\d+L,l_partkey#\d+L,l_extendedprice#\d+\]", scan)
    plan = plan_of(QUERIES["w_high_value_leads"](spark, SF_DIR))
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_entry_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    flagship = entry_module.entry(spark)
    assert flagship.columns == ["n_name", "p_type", "total_revenue", "customer_count"] and flagship.count() > 0


@pytest.mark.parametrize("left_out", [("rillway/llm",), ("rillway/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_optional_parts(tmp_path, left_out):
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    for name in ("rillway", "corpus_pipeline.py", "__spark_entry__.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=lambda folder, names: [
                n for n in names if n == "__pycache__" or os.path.relpath(os.path.join(folder, n), root) in left_out
            ])
        elif os.path.exists(source) and name not in left_out:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    n, sql = map(int, done.stdout.split())
    assert n >= len(QUERIES) and sql >= len(ORACLES)
