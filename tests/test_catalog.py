import pytest
from compare import SF, compare, connect

from docloom.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
