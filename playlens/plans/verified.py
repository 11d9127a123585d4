"""Verified questions over the live tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.timefns import boundary_diff
from playlens.plans.feeds import largest, timeline


def event_frequency(game_events: DataFrame) -> DataFrame:
    """Which events occur most often?"""
    return largest(game_events.groupBy("event_type").agg(F.count("*").alias("event_count")), "event_count")


def deaths_per_level(deaths_by_level: DataFrame) -> DataFrame:
    """Which level has the most deaths?"""
    return largest(deaths_by_level.select("level", "deaths"), "deaths")


def key_frequency(key_presses: DataFrame) -> DataFrame:
    """Which keys are pressed most often?"""
    return largest(key_presses.select("key_name", "presses"), "presses")


def powerup_totals(powerups: DataFrame) -> DataFrame:
    """Which powerups are collected most?"""
    return largest(powerups.groupBy("powerup_type").agg(F.sum("count").alias("total")), "total")


def sessions_by_coins(player_sessions: DataFrame) -> DataFrame:
    """Which sessions collected the most coins?"""
    columns = ("player_name", "session_id", "highest_level", "deaths", "levels_won", "coins")
    return largest(player_sessions.select(*columns), "coins")


def events_per_hour(game_events: DataFrame) -> DataFrame:
    """How many events occurred per hour?"""
    hour = F.window("timestamp", "1 hour")["start"]
    return game_events.select(hour.alias("hour")).groupBy("hour").agg(F.count("*").alias("events")).orderBy("hour")


def recent_timeline(event_timeline: DataFrame) -> DataFrame:
    """What happened most recently?"""
    return timeline(event_timeline, limit=20).select("event_type", "minute", "event_count")


def powerups_by_level(powerups: DataFrame) -> DataFrame:
    """Which powerups were collected on each level?"""
    return powerups.select("level", "powerup_type", "count").orderBy("level", F.desc("count"), "powerup_type")


def activity_summary(game_events: DataFrame) -> DataFrame:
    """How much activity is there overall?"""
    return game_events.agg(
        F.count("*").alias("total_events"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("event_type").alias("event_types"),
    )


def session_outcomes(player_sessions: DataFrame) -> DataFrame:
    """How long did each session last, and what was achieved?"""
    return player_sessions.select("player_name", "session_id", "deaths", "levels_won", "coins", "duration_seconds")


def session_minutes(player_sessions: DataFrame) -> DataFrame:
    """The same in whole minutes."""
    minutes = boundary_diff("MINUTE", "session_start", "session_end")
    return player_sessions.select("session_id", "deaths", "levels_won", "coins", minutes.alias("duration_minutes"))


def sessions_per_player(player_sessions: DataFrame) -> DataFrame:
    """Which players have the most sessions?"""
    return largest(
        player_sessions.groupBy("player_name").agg(
            F.count("*").alias("session_count"),
            F.sum("coins").alias("total_coins"),
            F.sum("deaths").alias("total_deaths"),
        ),
        "session_count",
    )


def player_deaths(deaths_by_level: DataFrame) -> DataFrame:
    """How do players compare in deaths per level?"""
    return largest(deaths_by_level.select("player_name", "level", "deaths"), "deaths")
