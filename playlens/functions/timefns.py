"""Time arithmetic. Timestamps without zone hold UTC; the session zone is UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.vocabulary import DEFAULT_ZONE

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def moment(df: DataFrame, value, column: str = "timestamp") -> Column:
    """``value`` (text, datetime or Column) as a value of the type of ``column``."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(df.schema[column].dataType)


def now_of(df: DataFrame, as_of=None, column: str = "timestamp") -> Column:
    """``as_of``, or else the newest time in ``df`` as a scalar subquery of the same plan."""
    if as_of is None:
        return df.select(F.max(column)).scalar()
    return moment(df, as_of, column)


def ago(now: Column, *, hours: int = 0, minutes: int = 0) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes), F.lit(0))


def slice_minutes(column, minutes: int = 1) -> Column:
    """Start of the epoch-aligned slice of ``minutes``; keeps the timestamp type."""
    return F.window(column, f"{minutes} minutes")["start"]


def boundary_diff(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed between two times (0.9 s to 1.1 s is 1 second)."""
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, end))


def local_time(column, zone: str = DEFAULT_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(column) if isinstance(column, str) else column)


def local_text(column, zone: str = DEFAULT_ZONE) -> Column:
    return F.date_format(local_time(column, zone), ISO_SECONDS)
