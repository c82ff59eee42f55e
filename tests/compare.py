"""Rows of a Spark query and of its SQL, in a form in which they can be compared."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    result = con.sql(sql)
    assert sorted(result.columns) == names
    columns = ", ".join(f'"{c}"' for c in names)
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {columns} FROM ({sql})").fetchall())
    assert got == want
