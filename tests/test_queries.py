"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import pytest

from gradelake.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, agree):
    agree(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
