"""Compares registered queries with their SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def compare(spark, sf_dir, f, sql):
    """None when equal, else what differs."""
    got = f(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    cols = sorted(got.columns)
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    have = sorted((tuple(plain(x) for x in r) for r in got.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} of {len(have)} rows, {cols}: {bad[:2]}" if bad else None
