"""Runs a query and its SQL on the same tables and compares schema, rows and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def sql_engine(sf_dir: str):
    engine = duckdb.connect()
    for table in TABLES.split():
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return engine


def _sortable(row):
    return [(v is None, str(type(v)) if v is not None else "", repr(v) if not isinstance(v, float) else f"{v:030.9f}") for v in row]


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def differences(df, sql: str, engine, tolerance: float = 0.0) -> list[str]:
    """Empty when both sides agree; otherwise what differs."""
    wanted = engine.sql(sql)
    left_names, right_names = sorted(df.columns), sorted(wanted.columns)
    if left_names != right_names:
        return [f"columns {set(left_names) ^ set(right_names)}"]
    left_frame = df.select(*left_names).toPandas()
    left = [tuple(map(normal, r)) for r in left_frame.itertuples(index=False, name=None)]
    places = [wanted.columns.index(n) for n in left_names]
    right = [tuple(normal(r[p]) for p in places) for r in wanted.fetchall()]
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"]
    keys = [i for i, n in enumerate(left_names) if n in {"id", "split", "part", "label", "fold", "bin", "feature", "column_name", "key", "doc_id", "page_id", "held_out"}]
    order = lambda r: ([_sortable([r[i]]) for i in keys], _sortable(r))
    found = []
    for a, b in zip(sorted(left, key=order), sorted(right, key=order)):
        for name, x, y in zip(left_names, a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance)
            if not same:
                found.append(f"{name}: {x!r} != {y!r} in {a[:3]}")
        if len(found) > 5:
            break
    types = {n: type(x) for n, x in zip(left_names, left[0])} if left else {}
    for name, y in zip(left_names, right[0] if right else ()):
        if types[name] is not type(y) and None not in (y, left[0][left_names.index(name)]):
            found.append(f"type of {name}: {types[name]} != {type(y)}")
    return found
