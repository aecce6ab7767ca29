"""Every registered query that has SQL gives the rows of its SQL."""

import pytest

from itemloom.plans import registry
from oracle import DATA, connect, oracle_rows, rows_of


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns, expected = oracle_rows(con, registry.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry_gives_the_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["topic_id", "topic", "chapter", "subject", "n_items", "weakness", "mastery_rate"]
    assert all(0 <= r.weakness <= 1 for r in df.collect())


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
