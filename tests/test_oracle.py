"""Every registered query against its SQL, with a look at its plan; queries without SQL must run."""

import pytest
from oracle import compare, connect

from huntlake.suite import ORACLES, QUERIES

# joins that compare every row with every row, and row-at-a-time Python
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in UNWANTED if p in plan]
    if name not in ORACLES:
        df.collect()  # the small scale may have no finding; values are tested in test_operators.py
        return
    problem = compare(con, df, ORACLES[name])
    assert problem in (None, "no rows"), problem
