"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(r[i]) for i in places) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    assert got
    if name not in ORACLES:
        return
    relation = duck.sql(ORACLES[name])
    kinds = {f.name: KINDS[f.dataType.simpleString()] for f in frame.schema}
    assert kinds == dict(zip(relation.columns, map(str, relation.types)))
    assert ordered(got, frame.columns) == ordered(relation.fetchall(), relation.columns)


def test_trained_loss_falls(spark):
    rows = QUERIES["fitted_q_loss"](spark, FOLDER).orderBy("step").collect()
    assert rows[-1].loss < rows[0].loss


def test_entry(spark):
    assert driver.entry(spark).count() > 0
