"""Run a query in Spark and its SQL in DuckDB and compare the rows as a bag."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from workload.tables import TABLES


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark_df, con, text: str) -> str | None:
    """None if equal, else what differs."""
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    g, w = bag(got_cols, got), bag(want_cols, want)
    if g != w:
        return (
            f"{len(got)} vs {len(want)} rows; columns {sorted(got_cols)}; "
            f"only spark {list((g - w).items())[:3]}; only sql {list((w - g).items())[:3]}"
        )
    return None
