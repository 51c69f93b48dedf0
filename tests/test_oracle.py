"""Every registered query of the graph engine against DuckDB, at the smallest scale."""

import pytest
from oracle import connect, spark_rows, sql_rows

from graphloom import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = spark_rows(queries.QUERIES[name](spark, sf_dir))
    assert got == sql_rows(con, queries.ORACLE_SQL[name])
