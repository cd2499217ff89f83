"""Each driver query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from skyframe.plans import oracle, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 5) + 0.0 if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(oracle.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle.ORACLE_SQL) == set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
