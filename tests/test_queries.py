"""Every registered query of the core runs, and agrees with its SQL where it has one."""

import pytest

from tallyweir import queries, rollup_queries

from .oracle import compare, connect

QUERIES = rollup_queries.QUERIES | queries.QUERIES
SQL = rollup_queries.SQL | queries.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        compare(con, df, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
