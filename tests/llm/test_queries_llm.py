"""Queries of this subpackage beside their SQL, and what must not be in their plans."""

import pytest

from check import compare, connect
from paperloom.llm import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, SF_DIR)
    assert ok, note


def test_one_query_for_each_operator():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{k}" for k in range(1, 14))


def test_chat_format_stays_native(spark):
    plan = QUERIES["op5_chat_format"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan
