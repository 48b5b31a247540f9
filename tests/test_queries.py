"""Every query of the core runs on the smallest tables and equals its SQL."""

import pytest

from tests.oracle import connect, same
from tidewater.queries import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.sql()
#: Queries without rows on the smallest tables: no text there has split ligatures.
EMPTY = {"ligature_repair"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0 or name in EMPTY


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).count() == 30


def test_columns(spark, sf):
    assert QUERIES["p1_found"](spark, sf).dtypes == [("table_name", "string"), ("row_id", "bigint")]
    assert QUERIES["p3_found"](spark, sf).dtypes == [("vessel_id", "bigint"), ("field", "string")]
