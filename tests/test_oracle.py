"""Every registered query against its SQL twin on the small tables."""

import pytest

from metricloom.catalog import CATALOG
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_query_equals_sql(name, spark, sf, con):
    item = CATALOG[name]
    assert difference(item.run(spark, sf), con, item.sql) is None


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_query_without_sql_gives_rows(name, spark, sf):
    assert CATALOG[name].run(spark, sf).count() > 0
