"""Rows of a registered query and of its SQL, in one comparable form."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb


def tables(sf_dir: str):
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return db


def _plain(x):
    return round(x, 9) if isinstance(x, float) else float(x) if isinstance(x, Decimal) else str(x)


def rows_of_sql(db, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = db.execute(sql)
    return _sorted([d[0] for d in cursor.description], cursor.fetchall())


def rows_of(df) -> tuple[list[str], list[tuple]]:
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def _sorted(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)
