"""Every engine query that has a SQL twin gives the twin's rows; the others give rows."""

from __future__ import annotations

import pytest
from twins import DATA, assert_twins, connect

from gleaner import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert_twins(spark, con, catalog.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
