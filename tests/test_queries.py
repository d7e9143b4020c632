"""Every query against its SQL on the smallest tables; those without SQL must run and keep a schema."""

from __future__ import annotations

import pytest
from oracle import DATA, same

from pairloom.plans.catalog import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
