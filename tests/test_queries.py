"""Every query with SQL gives exactly the rows that DuckDB gives on the same tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(rows, columns):
    """Rows with columns by name, each value with its kind, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return ("float", x + 0.0)
        if isinstance(x, datetime.datetime):
            return ("time", x.isoformat())
        return (type(x).__name__, x)

    return [columns[i] for i in order], sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    expected = comparable(cursor.fetchall(), [d[0] for d in cursor.description])
    assert comparable([tuple(r) for r in df.collect()], df.columns) == expected


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_language_queries_deal_their_texts_out(spark):
    from workload.bindings import TEXT_TASKS
    from workload.models import _marked

    assert _marked(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= TEXT_TASKS
