"""Every query against its DuckDB SQL; those without give rows."""

import oracle
import pytest

from rastrel.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    assert oracle.differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""
    assert con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_kernels_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
