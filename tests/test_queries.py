"""Every registered query against its SQL, on the smallest data set."""

import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry_point

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{file}'")
    return connection


def comparable(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    number = float(value)
    return "None" if math.isnan(number) else f"{number:.6f}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(comparable(row[i]) for i in order) for row in rows)


def test_each_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    result = QUERIES[name](spark, SF)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = [tuple(row) for row in result.collect()]
    if name not in SQL:
        assert rows and len(set(result.columns)) == len(result.columns)
        return
    expected = tables.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(result.columns)
    assert rows_of(result.columns, rows) == rows_of(columns, expected.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    def plan(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "EqualTo(o_orderpriority,2-HIGH)" in plan("list_models")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("exact_dedup_kept_ids")
    assert "ReadSchema: struct<text:string>" in plan("text_length_stats")
