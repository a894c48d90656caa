"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

from helixframe.plans import registry

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first = registry.QUERIES[name](spark, SMALL).toPandas()
    assert len(first)
    assert rows_of(first) == rows_of(registry.QUERIES[name](spark, SMALL).toPandas())
