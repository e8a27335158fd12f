import pytest

import __spark_entry__ as entry
from disparity_spark import plans
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    agree(spark, small, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "most"), [("ks_statistic", 2), ("fidelity_verdict", 6), ("bias_amplification", 4), ("amplification_verdict", 4)])
def test_scans(spark, small, name, most):
    """A table is read once for each side, not again for every step (as planned; reuse at run time may save more)."""
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().simpleString()
    assert 0 < plan.count("FileScan parquet") <= most
