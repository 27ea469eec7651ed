"""Every query of the ledger gives DuckDB's rows."""

import pytest
from compare import assert_same
from conftest import SF

from strandbook.plans import document_queries, event_queries, reader_queries, session_queries, table_queries, watch_queries

MODULES = (event_queries, table_queries, session_queries, reader_queries, watch_queries, document_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert_same(QUERIES[name], SQL[name], spark, SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
