"""Every query that has SQL against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.12g}")
    return bytes(x) if isinstance(x, bytearray) else x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, DIR)
    rows = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rows.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in sorted(names)] for r in got.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: r.key)
    assert set(entry.oracle_sql()) <= set(entry.queries())
