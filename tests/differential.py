"""Rows of a Spark query and of its SQL on the same tables, in a form that can be compared."""

import os

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
