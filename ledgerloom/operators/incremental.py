"""High-water marks: where a load starts, and which rows it takes."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_mark(marks: DataFrame, source_name: str) -> datetime | None:
    """The mark last written for a source, in UTC."""
    row = marks.where(F.col("source_name") == source_name).orderBy(F.col("updated_at").desc()).select("last_successful_transaction_date").first()
    return row[0].astimezone(timezone.utc) if row and row[0] else None


def start_value(mark: datetime | None, lookback_hours: int = 0) -> str | None:
    return None if mark is None else (mark - timedelta(hours=lookback_hours)).isoformat().replace("+00:00", "Z")


def advances(mark: datetime | None, new: datetime | None, monotonic: bool = False) -> bool:
    """Whether a load writes a new mark: one that is there, and if marks are monotonic none before the old."""
    return new is not None and not (monotonic and mark is not None and new.astimezone(timezone.utc) < mark)


def past_mark(rows: DataFrame, start: str, inclusive: bool, known_ids: DataFrame | None = None, date: str = "transaction_date", id_: str = "transaction_id") -> DataFrame:
    """Rows dated after start (at it too, if inclusive), and undatable ones whose id isn't known yet.

    date is a text or timestamp column; only undatable rows are held against known_ids.
    """
    at, from_ = F.col(date).try_cast("timestamp"), F.lit(start).cast("timestamp")
    if known_ids is None:
        return rows.where(at.isNull() | (at >= from_ if inclusive else at > from_))
    dated = rows.where(at >= from_ if inclusive else at > from_)
    ids = known_ids.where(F.col(id_).isNotNull()).select(F.col(id_).alias("__i")).distinct()
    return dated.unionByName(rows.where(at.isNull()).join(ids, F.col(id_) == F.col("__i"), "left_anti"))


def known_ids(*tables: DataFrame, id_: str = "transaction_id") -> DataFrame:
    out = tables[0].select(id_)
    for t in tables[1:]:
        out = out.unionByName(t.select(id_))
    return out.where(F.col(id_).isNotNull()).distinct()
