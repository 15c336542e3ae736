"""Runs a registered query and its oracle SQL side by side and compares the values."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str):
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    s_names, s_rows = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    d_types = {c[0]: str(c[1]) for c in rel.description}
    o_names, o_rows = rows([c[0] for c in rel.description], rel.fetchall())
    if s_names != o_names:
        return f"columns {set(s_names) ^ set(o_names)}"
    if len(s_rows) != len(o_rows):
        return f"rows {len(s_rows)} vs {len(o_rows)}"
    bad = [(a, c) for a, c in zip(s_rows, o_rows) if a != c]
    if bad:
        diff = [n for n, x, y in zip(s_names, *bad[0]) if x != y]
        return f"{len(bad)} rows differ, first in {diff}: {bad[0]}"
    kinds = dict(df.dtypes)
    for n in s_names:
        wide = d_types[n] in ("HUGEINT",) or d_types[n].startswith("DECIMAL")
        if wide or (kinds[n] in ("bigint", "int") and d_types[n] in ("DOUBLE",)) or (
            kinds[n] == "double" and d_types[n] not in ("DOUBLE", "FLOAT")
        ):
            return f"type of {n}: {kinds[n]} vs {d_types[n]}"
    return None if s_rows else "empty result"
