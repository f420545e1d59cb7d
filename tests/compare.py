"""Compares a query's rows with its SQL's, as sets of text rows with columns in the order of their names."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if abs(x) < 1e15 else repr(x)
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.6g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return repr(x)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in got.fetchall()])


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect()])
