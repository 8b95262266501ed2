"""Every query that has SQL equals it in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v).hex() if isinstance(v, bytearray | bytes) else str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a = sorted(([plain(r[want.columns.index(c)]) for c in columns] for r in want.fetchall()), key=str)
    b = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    assert len(a) == len(b)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
