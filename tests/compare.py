"""Rows of a Spark query against those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5)
    return x


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(row[c]) for c in columns) for row in df.collect()), key=repr)
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert ours == theirs
