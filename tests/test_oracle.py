"""Every registered query with checking SQL gives the same names, types and rows in both engines."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(types) == columns
    assert {c: SQL_TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted(([normal(r[i]) for i in place] for r in cursor.fetchall()), key=str)
    actual = sorted(([normal(r[c]) for c in columns] for r in df.collect()), key=str)
    assert actual == expected


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_all_hours(spark):
    assert entry(spark).count() == 24
