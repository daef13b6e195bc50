"""Spark results against DuckDB's, as multisets of rows with columns in order of name."""

from pathlib import Path

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr), [cols[i] for i in order]


def assert_same(df, con, sql):
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, wanted = rows([c[0] for c in cur.description], cur.fetchall())
    assert names == wanted
    assert len(got) == len(want)
    assert got == want
