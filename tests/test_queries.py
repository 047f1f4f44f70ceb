"""Every query of the hot-spot library against its DuckDB counterpart on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import oracle
from check_queries import duckdb_tables, sorted_rows

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return duckdb_tables(SF_DIR)


def test_every_query_has_sql():
    assert set(entry_point.CORE) == set(oracle.statements())
    assert set(oracle.statements()) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_without_the_operators_for_training_data(monkeypatch):
    monkeypatch.setattr(entry_point, "llm_queries", None)
    assert set(entry_point.queries()) == set(entry_point.CORE) == set(entry_point.oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    cursor = con.execute(entry_point.oracle_sql()[name])
    kinds = {d[0]: KIND.get(str(d[1]), str(d[1]).lower()) for d in cursor.description}
    assert dict(df.dtypes) == kinds
    want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted_rows(df.columns, df.collect()) == want


@needs_tables
def test_entry(spark):
    assert entry_point.entry(spark).columns == ["row_id", "lat", "lon", "fitness"]
