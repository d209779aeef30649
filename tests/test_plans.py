"""Plan shape of every registered ledger query: no Python evaluation, no nested-loop or
cartesian joins; aggregates are partial before their shuffle."""

import pytest

from carrierbook.plans import catalog
from tests.conftest import SF_SMALL

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


# Queries that play a stream give a scan of the tables it wrote; their plans are the batches' own.
PLAYED = {"live_cases", "live_lines", "live_notices", "live_stock_exact", "case_change_log"}


@pytest.mark.parametrize("name", sorted(set(catalog.query_callables()) - PLAYED))
def test_plan_has_no_python_or_nested_loops(spark, name):
    df = catalog.run(spark, SF_SMALL, name)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node}"


def test_stock_aggregates_before_the_shuffle(spark):
    df = catalog.run(spark, SF_SMALL, "stock_overall")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
