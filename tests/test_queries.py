import pytest

import __spark_entry__ as entry_point
from spoolyard.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_one_exchange_for_the_lanes(spark, sf_dir):
    """Windows, and the meeting of slots and fires, share the lanes' partitioning."""
    plan = catalog.log(spark, sf_dir, 4, False)
    from spoolyard.operators import replay

    text = replay.fired(plan)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
