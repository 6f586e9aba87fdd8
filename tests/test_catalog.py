import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, con, sf, name):
    good, text = compare(spark, con, sf, name, oracle_sql().get(name))
    assert good, text


def test_entry(spark):
    frame = entry(spark)
    assert "summary" in frame.columns and frame.count() == 40
