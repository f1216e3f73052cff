"""Compare a Spark result with DuckDB's over the same tables, as sorted rows by column name."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    """Floats to nine digits, nested values to tuples."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, (str, bool, int)) else round(float(v), 6) if "Decimal" in type(v).__name__ else str(v)


def differences(df, con, sql: str, show: int = 3) -> str:
    """Empty if equal, else what differs."""
    got = df.collect()
    rel = con.execute(sql)
    names, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(df.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"rows {len(a)} against {len(b)}; {order}; only Spark {only_a[:show]}; only SQL {only_b[:show]}"
