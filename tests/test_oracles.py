"""Every query that SQL can express gives DuckDB's rows."""

import compare
import pytest

from pagespan.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    compare.same(catalog.queries()[name](spark, sf), con, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.queries())
