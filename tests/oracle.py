"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return float(round(v, 5)) if type(v).__name__ == "Decimal" else v


def rows(columns, found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=repr)


def same(spark, sf_dir, query, sql) -> None:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    con = connect(sf_dir)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall()
    assert rows(names, df.select(*names).collect()) == rows(names, want)
