"""Every query with a SQL counterpart, on the smallest tables, against DuckDB."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = entry_point.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()[:10]
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    expected = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == expected


def test_entry_has_one_row_per_assortment(spark):
    assert {r["assortment"] for r in entry_point.entry(spark).collect()} == {"basic", "extra", "extended"}


def test_names_are_consistent():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["table_dtypes", "sample_rows", "model_roundtrip", "linear_regression"])
def test_rows_only_queries_run(spark, name):
    rows = entry_point.queries()[name](spark, FOLDER).collect()
    assert rows
    if name == "model_roundtrip":
        assert rows[0]["largest_gap"] < 1e-9


def plan_of(frame):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_totals_prune_columns_and_use_no_python(spark):
    plan = plan_of(entry_point.queries()["sales_by_assortment"](spark, FOLDER))
    assert "l_orderkey" not in plan and "s_acctbal" not in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_date_split_reaches_the_scan(spark):
    plan = plan_of(entry_point.queries()["filter_not_null"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_shipdate" in plan
