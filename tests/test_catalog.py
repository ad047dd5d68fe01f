"""Every catalogued query plans well: no nested loops, no window over a whole table."""

import re

import pytest

import __spark_entry__ as contract
from talkweave import catalog

FOLDER = "/root/testdata/sf0.001"


def test_contract_shape():
    queries, oracle, own = contract.queries(), contract.oracle_sql(), catalog.entries()
    assert set(oracle) <= set(queries) and set(own) <= set(queries)
    assert {name for name, (_, sql) in own.items() if sql is None} == set(own) - set(oracle) == {"ann_topk", "hash_embed"}


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(catalog.entries()))
def test_plan(spark, key):
    df = catalog.entries()[key][0](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    for line in re.findall(r"Window \[.*", plan):
        # windowspecdefinition(first, ...) names at least one partition column before its order
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", line):
            assert not spec.split(",")[0].strip().endswith(("ASC NULLS FIRST", "DESC NULLS LAST"))
