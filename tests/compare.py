"""Run a registered query and its checking SQL over the same tables and compare."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def differences(spark, db, name, run, check, sf_dir) -> str | None:
    """NULL when both sides agree, else what differs."""
    result = run(spark, sf_dir)
    got = _rows(result.columns, result.collect())
    cursor = db.execute(check)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(result.columns):
        return f"{name}: columns {sorted(result.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows != {len(want)}; {_first(got, want)}"
    if got != want:
        return f"{name}: {_first(got, want)}"
    return None if got else f"{name}: both sides are empty"


def _first(got, want) -> str:
    got_only = [r for r in got if r not in set(want)][:3]
    want_only = [r for r in want if r not in set(got)][:3]
    return f"only here {str(got_only)[:600]}; only there {str(want_only)[:600]}"
