"""Every registered query against its SQL twin, over whole tables."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, duck
from tidelake.plans import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    sql = entry_points.oracle_sql()[name]
    difference = compare(entry_points.queries()[name](spark, SF), connection, sql)
    assert difference is None, difference


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["id", "name", "brandId", "price", "customerId", "createdAt"]
    assert df.count() > 0
