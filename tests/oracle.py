"""Queries against their SQL in DuckDB, over one folder of tables."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.endswith(".parquet"):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{files}')")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda x: f"{x:.12g}" if isinstance(x, float) else x
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert _plain(df.collect(), df.columns) == _plain(relation.fetchall(), relation.columns)
