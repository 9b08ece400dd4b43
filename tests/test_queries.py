"""Every registered query against its DuckDB counterpart on the smallest tables."""

import pytest

from compare import rows_of
from lumeset import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.astype(object)) == rows_of(want.astype(object))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
