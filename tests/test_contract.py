"""Every registered query against its SQL at the smallest scale, and what its plan may not contain."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from checks import all_queries
from __spark_entry__ import entry
from conftest import TESTDATA

TABLES = "documents embeddings benchmark conversations".split()
SQL = all_queries.oracle_sql()
QUERIES = all_queries.queries()
#: Fits models or reads back what it wrote; covered by tests of their own.
SLOW = {"j6_best_k"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{TESTDATA}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def results(spark):
    """All queries, several at a time: on tables this small most of the time is planning."""

    def run(name):
        df = QUERIES[name](spark, TESTDATA)
        columns = sorted(df.columns)
        rows = [[row[c] for c in columns] for row in df.collect()]
        return df._jdf.queryExecution().executedPlan().toString(), columns, rows

    with ThreadPoolExecutor(6) as pool:
        return {name: pool.submit(run, name) for name in QUERIES if name not in SLOW}


def _normal(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(map(cell, row)) for row in rows), key=repr)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 100


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(results, duck, name):
    plan, columns, rows = results[name].result()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"):
        assert banned not in plan
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(expected.column_names) == columns
    assert _normal(rows) == _normal(zip(*[expected[c].to_pylist() for c in columns]))


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "pain_score" in df.columns


def test_scans_are_pruned(spark):
    plan = QUERIES["a4_parquet_scan"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,500)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan


@pytest.mark.parametrize("name", ["select_posts", "j7_top_terms"])
def test_results_do_not_depend_on_partitions(spark, name):
    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return sorted(map(repr, QUERIES[name](spark, TESTDATA).collect()))

    try:
        assert rows(1) == rows(13)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
