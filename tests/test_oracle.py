"""Every query with SQL against that SQL; every query without SQL gives rows."""

import pytest
from comparison import differences, sql_engine
from conftest import SF_DIR

from stratafold.catalog import registered
from stratafold.oracle import oracle

QUERIES, SQL = registered(), oracle()


@pytest.fixture(scope="module")
def engine():
    return sql_engine(SF_DIR)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, name):
    assert differences(QUERIES[name](spark, SF_DIR), SQL[name], engine) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
