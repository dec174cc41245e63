"""Every catalogue query against its SQL statement: same columns, types and rows."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from tallywise.plans import CATALOGUE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def comparable(rows):
    def value(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(value(v) for v in row) for row in rows)


def test_every_query_has_sql():
    assert set(CATALOGUE) <= set(driver.queries())
    assert all(query.sql for query in CATALOGUE.values())


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = driver.queries()[name](spark, sf_dir)
    relation = db.sql(driver.oracle_sql()[name])
    columns = sorted(relation.columns)
    assert sorted(df.columns) == columns
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == expected_types
    expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    actual = df.select(*[f"`{c}`" for c in columns]).collect()
    assert len(actual) == len(expected)
    assert comparable(actual) == comparable(expected)


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 10
