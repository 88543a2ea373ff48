"""Runs a query and its SQL over the same tables and compares rows by column name."""

import glob
import os

import duckdb

DATA = os.environ.get("SEQTIDE_TESTDATA", "/root/testdata/sf0.001")


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return round(float(v), 6)


def compare(spark, query, sql: str, path: str = DATA) -> None:
    got = query(spark, path)
    result = connect(path).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in order) for r in got.collect()) == want
