"""Newest-first and largest-first lists.

Lists with a limit plan as top-k per task and a merge of those. Ties in time are broken by event
id, so a list is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.attributes import integer, json_text, text
from playlens.functions.predicates import has_prefix, is_event, last, not_event, of_player
from playlens.functions.timefns import local_text, local_time
from playlens.operators.projections import game_logs
from playlens.sources.event_table import scan_service_records
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE, DEFAULT_ZONE

FEED = (
    "event_id",
    "event_type",
    "player_name",
    "level",
    "coins",
    "lives",
    "key_name",
    "powerup_type",
    "duration",
    "session_id",
)


def newest(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


def event_feed(
    game_events: DataFrame,
    *,
    limit: int = 500,
    player: str | None = None,
    zone: str = DEFAULT_ZONE,
    as_text: bool = False,
) -> DataFrame:
    """Newest events other than key presses, in local time."""
    return shown_feed(newest(fed(game_events, player), limit), zone=zone, as_text=as_text)


def fed(game_events: DataFrame, player: str | None = None) -> DataFrame:
    """The events that feeds list."""
    return of_player(game_events, player).where(not_event("key_press"))


def shown_feed(rows: DataFrame, *, zone: str = DEFAULT_ZONE, as_text: bool = False) -> DataFrame:
    shown = local_text("timestamp", zone) if as_text else local_time("timestamp", zone)
    return rows.select(*FEED, shown.alias("timestamp"))


def timeline(event_timeline: DataFrame, *, limit: int | None = None, zone: str | None = None, as_text: bool = False):
    """Newest timeline rows, or all in time order without a limit."""
    if limit is None:
        rows = event_timeline.orderBy("minute", "event_type")
    else:
        rows = event_timeline.orderBy(F.desc("minute"), "event_type").limit(limit)
    if zone:
        rows = rows.withColumn("minute", local_text("minute", zone) if as_text else local_time("minute", zone))
    return rows


def recent_sessions(game_events: DataFrame, *, limit: int = 50, player: str | None = None) -> DataFrame:
    """Newest finished games."""
    return shown_sessions(newest(finished(game_events, player), limit))


def finished(game_events: DataFrame, player: str | None = None) -> DataFrame:
    return of_player(game_events, player).where(is_event("game_over"))


def shown_sessions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "player_name",
        F.col("timestamp").alias("session_start"),
        "level",
        F.col("coins").try_cast("int").alias("coins"),
        F.col("lives").try_cast("int").alias("lives"),
        F.round(F.col("duration").try_cast("double"), 1).alias("duration_seconds"),
    )


def largest(table: DataFrame, *measures: str, limit: int | None = None) -> DataFrame:
    """Rows by descending ``measures``; the other columns break ties."""
    rest = [name for name in table.columns if name not in measures]
    rows = table.orderBy(*[F.desc_nulls_last(name) for name in measures], *rest)
    return rows if limit is None else rows.limit(limit)


def recent_spans(
    event_table: DataFrame, *, as_of=None, minutes: int = 5, limit: int = 25, prefix: str = DEFAULT_PREFIX
) -> DataFrame:
    """Newest game spans of any service, straight from the event table."""
    records = last(scan_service_records(event_table, None, "SPAN"), minutes=minutes, as_of=as_of, strict=True)
    rows = records.select(
        "event_id",
        "timestamp",
        text("record", "name").alias("event_type"),
        text("record_attributes", "player_name").alias("player_name"),
        text("record_attributes", "level").alias("level"),
        integer("record_attributes", "coins").alias("coins"),
        integer("record_attributes", "lives").alias("lives"),
    ).where(has_prefix(prefix))
    return newest(rows, limit).withColumnRenamed("event_type", "event_name")


def recent_logs(event_table: DataFrame, *, as_of=None, minutes: int = 10, limit: int = 20) -> DataFrame:
    """Newest log lines of any service."""
    rows = last(game_logs(event_table, service=None), minutes=minutes, as_of=as_of, strict=True)
    return newest(rows, limit).select("timestamp", "severity", F.col("log_message").alias("message"))


def latest_raw_span(event_table: DataFrame, *, service: str = DEFAULT_SERVICE) -> DataFrame:
    """The newest span as it is stored."""
    return raw_span(newest(scan_service_records(event_table, service, "SPAN"), 1))


def raw_span(records: DataFrame, *also: str) -> DataFrame:
    return records.select(
        *also,
        "timestamp",
        "record_type",
        text("record", "name").alias("event_name"),
        json_text("record_attributes").alias("record_attributes"),
    )


def sample(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The newest few rows, to look at."""
    return newest(rows, limit)
