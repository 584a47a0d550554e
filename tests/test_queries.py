"""Every core query against its SQL, at the scale of the correctness gate."""

from __future__ import annotations

import pytest

from gradeloom.plans import registry
from tests.conftest import DATA
from tests.oracle import compare

QUERIES, SQL = registry.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
