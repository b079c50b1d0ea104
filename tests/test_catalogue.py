"""Every query runs; those with SQL give the rows that DuckDB gives."""

import pytest

from folio import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
