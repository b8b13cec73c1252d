"""Every query outside the training-data operators against its SQL, on the smallest tables."""

import pytest

from srcgraph.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import database, difference


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
