"""Holds a query's rows against those that DuckDB gives for its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str):
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for name in TABLES:
            path = Path(sf_dir, f"{name}.parquet")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
        found = db.execute(sql)
        return rows_of([c[0] for c in found.description], found.fetchall())


def difference(df, sf_dir: str, sql: str) -> str:
    """What differs, in a few words; empty if nothing does."""
    names, rows = rows_of(df.columns, df.collect())
    other_names, other = duck(sf_dir, sql)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if len(rows) != len(other):
        return f"{len(rows)} rows against {len(other)}"
    bad = [(a, b) for a, b in zip(rows, other, strict=True) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, first {bad[0][0]} against {bad[0][1]}" if bad else ""
