"""Row predicates used across the queries. All are plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.timefns import ago, moment, now_of
from playlens.vocabulary import DEFAULT_PREFIX, UNKNOWN_PLAYER


def has_prefix(prefix: str = DEFAULT_PREFIX, column: str = "event_type") -> Column:
    return F.col(column).startswith(prefix)


def is_event(*names: str, prefix: str = DEFAULT_PREFIX) -> Column:
    types = [prefix + name for name in names]
    return F.col("event_type") == types[0] if len(types) == 1 else F.col("event_type").isin(types)


def not_event(*names: str, prefix: str = DEFAULT_PREFIX) -> Column:
    return ~is_event(*names, prefix=prefix)


def known_player(column: str = "player_name") -> Column:
    return F.col(column).isNotNull() & (F.col(column) != UNKNOWN_PLAYER)


def of_player(df: DataFrame, player: str | None) -> DataFrame:
    """``df`` restricted to one player, or unchanged. The name is a bound value, never SQL text."""
    return df if player is None else df.where(F.col("player_name") == F.lit(player))


def last(df: DataFrame, *, hours: int | None = 0, minutes: int = 0, as_of=None, strict: bool = False) -> DataFrame:
    """Rows of the last ``hours`` and ``minutes`` before ``as_of``; of all time if ``hours`` is None."""
    if hours is None:
        return df
    bound = ago(now_of(df, as_of), hours=hours, minutes=minutes)
    return df.where(F.col("timestamp") > bound if strict else F.col("timestamp") >= bound)


def in_range(
    df: DataFrame, *, as_of=None, minutes: int | None = None, start=None, end=None, strict: bool = False
) -> DataFrame:
    """Rows between ``start`` and ``end`` (both included), and of the last ``minutes`` (without their start if ``strict``)."""
    if start is not None:
        df = df.where(F.col("timestamp") >= moment(df, start))
    if end is not None:
        df = df.where(F.col("timestamp") <= moment(df, end))
    return df if minutes is None else last(df, minutes=minutes, as_of=as_of, strict=strict)


def contains_text(column: str, needle: str) -> Column:
    return F.col(column).ilike(f"%{needle}%")
