"""Holds a query's rows against those that DuckDB gives for its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows(names: list[str], data) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(v is None, str(v)) for v in r])


def differences(df, con, sql: str) -> list[str]:  # noqa: ANN001
    """What differs, at most a few lines; nothing if all rows are the same."""
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    out = [] if len(have) == len(want) else [f"{len(have)} and {len(want)} rows"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    out += [f"{c}: {t} and {types[c]}" for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    return out + [f"{a} and {b}" for a, b in zip(have, want) if a != b][:3]
