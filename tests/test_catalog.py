"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import compare, connect

from offerloom.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def duck(small_tables):
    return connect(small_tables)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, duck, small_tables, name):
    query = CATALOG[name]
    rows, result = compare(spark, duck, name, query.run, query.sql, small_tables)
    assert result in ("ok", "rows only"), result


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
