"""The SQL side of a query, and the comparison of both."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def rows_by_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())
