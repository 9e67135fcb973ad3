"""Every query of the library with SQL, against DuckDB."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from abaculus.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, SQL[name])


def test_flagship(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_batch_query_covers_all_ranges_it_had(spark, sf_dir, duck):
    """Neither the first days of the tables nor the years of the query's first form are cut off."""
    from abaculus.plans.ledger_queries import batches

    want = batches(spark, sf_dir).where("cast(started_at as date) between '1992-01-01' and '1995-12-31' and status = 'done' and operator like '%3%' and n_records >= 5")
    assert {r.batch_id for r in QUERIES["p9_batch_query"](spark, sf_dir).collect()} == {r.batch_id for r in want.collect()}
    assert "1992-01-01" in SQL["p9_batch_query"] and "1995-12-31" in SQL["p9_batch_query"]
