"""Holds a query's rows against its SQL twin's."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or (not isinstance(v, list | str) and pd.isna(v)):
            return "~"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    return sorted(tuple(map(cell, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


def assert_twins(spark, con, query, sql: str, sf_dir: str = DATA) -> None:
    got, wanted = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert canonical(got) == canonical(wanted)
