"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from fieldlab import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.sql("SET timezone = 'UTC'")
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


def plain(frame):
    out = frame[sorted(frame.columns)].copy()
    for name in out:
        out[name] = out[name].astype(float).round(6).map(repr) if out[name].dtype.kind in "fiub" else out[name].map(_text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def _text(value):
    if value is None or value != value:
        return "nan"
    try:
        return repr(round(float(value), 6))
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for column in a:
        assert (a[column] == b[column]).all(), (column, a[a[column] != b[column]].head(3), b[a[column] != b[column]].head(3))


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def _with_newcomer(duck, folder):
    """DATA beside one more customer, who has neither orders nor events, and a connection over it."""
    for name in TABLES:
        more = " UNION ALL SELECT -1, 'Customer#new', 3, 10.5, 'FURNITURE'" if name == "customer" else ""
        duck.sql(f"COPY (SELECT * FROM {name}{more}) TO '{folder}/{name}.parquet'")
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return found


def _of_newcomer(spark, duck, tmp_path, name):
    over = _with_newcomer(duck, tmp_path)
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), over.sql(registry.ORACLE_SQL[name]).df()
    assert plain(got).equals(plain(want))
    return got[got.player_id == -1].iloc[0]


def test_availability_of_a_player_without_games(spark, duck, tmp_path):
    row = _of_newcomer(spark, duck, tmp_path, "dataset_availability")
    assert row.share == 0.25 and not row.ready


def test_readiness_of_a_player_without_games(spark, duck, tmp_path):
    row = _of_newcomer(spark, duck, tmp_path, "profile_readiness")
    assert (row.ready_parts, row.score, row.status) == (1, 20.0, "not_ready")
