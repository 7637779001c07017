"""Plan guards over every registered query: no cartesian or nested-loop joins."""

from stanceframe.plans import registry

from .conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_no_cross_or_nested_loop_joins(spark):
    bad = {}
    for name, fn in registry.queries().items():
        plan = fn(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}
