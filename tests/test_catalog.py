"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from corvina.plans import catalog

from .compare import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert rows_of(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
