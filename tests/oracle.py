"""Compare a query with its SQL in DuckDB, as sorted rows of text."""

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(x) -> str:
    if x is None or x != x:
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6))
    return x.isoformat() if isinstance(x, datetime.datetime) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted("|".join(text(r[i]) for i in order) for r in rows)


def same(df, con, sql: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    assert got == rows_of([d[0] for d in r.description], r.fetchall())
