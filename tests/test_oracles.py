"""Every query of the reference's operators against independent SQL."""

import pytest
from oracle import connect, same

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
#: Checked in test_models.py, as they have no SQL.
SLOW = {"model_comparison", "model_catalogue"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same(catalog.queries()[name](spark, SF), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
