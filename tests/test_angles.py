"""Angles that lie opposite each other but for rounding, against the SQL."""

import pytest

from skyframe.plans import oracle, queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def opposite(tmp_path_factory):
    """Per user a first and a last value 180 apart, and events between them."""
    folder = tmp_path_factory.mktemp("opposite")
    duckdb.execute(f"""COPY (WITH u AS (SELECT k, k / 100::DOUBLE AS x FROM range(1500) r(k)), e AS (
        SELECT k AS user_id, 0 AS s, unnest(['view', 'click', 'purchase']) AS event_type, x AS value FROM u
        UNION ALL SELECT k, 4, unnest(['view', 'click']), round(x + 180, 2) FROM u UNION ALL SELECT k, 1, 'error', 0 FROM u)
      SELECT row_number() OVER (ORDER BY user_id, s, event_type) - 1 AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s * 100) AS ts, user_id, event_type, value, '' AS props FROM e)
      TO '{folder}/events.parquet'""")
    return str(folder)


def differing(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    want = {r[0]: r[1:] for r in db.execute(oracle.ORACLE_SQL[name]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES[name](spark, folder).collect()}
    assert got.keys() == want.keys()
    return [k for k in want if got[k] != want[k]]


def test_asof_angle(spark, opposite):
    assert not differing(spark, opposite, "b_asof_angle")


def test_nav_fusion(spark, opposite):
    assert not differing(spark, opposite, "b_nav_fusion")
