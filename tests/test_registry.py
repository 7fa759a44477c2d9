"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from voxdesk.plans import registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, key):
    df = registry.queries()[key](spark, SF)
    result = duck.execute(ORACLE[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert as_rows(df.columns, df.collect()) == as_rows(names, result.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(registry.queries())


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0
