"""Every registered plan against its SQL on the smallest driver tables; a plan without SQL
names the test that holds it against brute force, in ``CHECKS`` of that test's module."""

import ast
import os
from pathlib import Path

import pytest
from oracle import compare

import __spark_entry__ as entry

SF = os.environ.get("EFFECTLAB_TEST_SF", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def checks():
    """The tests that modules name for queries, as far as they exist."""
    found = {}
    for path in Path(__file__).parent.rglob("test_*.py"):
        tree = ast.parse(path.read_text())
        tests = {node.name for node in tree.body if isinstance(node, ast.FunctionDef)}
        for node in tree.body:
            if isinstance(node, ast.Assign) and getattr(node.targets[0], "id", "") == "CHECKS":
                found |= {query: test for query, test in ast.literal_eval(node.value).items() if test in tests}
    return found


def test_a_plan_without_sql_has_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) <= set(checks())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_agrees_with_sql(spark, name):
    count, problem = compare(spark, SF, QUERIES[name], SQL.get(name))
    assert problem is None
    assert count > 0 or name in SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["arm", "direction", "target_change"]
    assert df.count() > 0
