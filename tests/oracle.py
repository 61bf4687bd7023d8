"""Runs a query and its oracle on the same tables and compares rows regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark: SparkSession, name: str, query, sql: str, sf_dir: str) -> None:  # noqa: ANN001
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf_dir).execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    assert len(got) == len(want), (name, len(got), len(want), got[:2], want[:2])
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (name, len(bad), bad[:3])
    assert glob.glob(f"{sf_dir}/*.parquet")
