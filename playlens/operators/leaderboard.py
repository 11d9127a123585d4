"""Scores of finished games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.predicates import is_event, known_player, last
from playlens.functions.timefns import local_time
from playlens.operators.ordered import global_rank
from playlens.vocabulary import DEFAULT_ZONE


def best_first(coins: Column, duration: Column) -> list[Column]:
    """Most coins, then shortest, then oldest id; missing numbers last."""
    return [coins.desc_nulls_last(), duration.asc_nulls_last(), F.col("event_id").asc()]


def top_scores(spans: DataFrame, *, as_of=None, hours: int | None = 24) -> DataFrame:
    """All games that ended in the last ``hours`` (or ever), ranked."""
    games = last(spans, hours=hours, as_of=as_of).where(is_event("game_over"))
    games = games.select("event_id", "timestamp", "player_name", "level", "coins", "session_duration")
    ranked = global_rank(games, best_first(F.col("coins"), F.col("session_duration")))
    return ranked.select(
        "rank",
        "player_name",
        F.col("timestamp").alias("game_time"),
        F.col("level").alias("final_level"),
        "coins",
        F.round("session_duration", 1).alias("duration_seconds"),
        F.round(F.col("session_duration") / 60, 1).alias("duration_minutes"),
    )


def leaderboard(
    game_events: DataFrame, *, as_of=None, hours: int = 24, limit: int = 20, zone: str = DEFAULT_ZONE
) -> DataFrame:
    """The best ``limit`` games of known players. Only those rows are numbered."""
    games = last(game_events, hours=hours, as_of=as_of).where(is_event("game_over") & known_player())
    typed = games.select(
        "event_id",
        "player_name",
        F.col("level").alias("final_level"),
        F.col("coins").try_cast("int").alias("coins"),
        F.col("duration").try_cast("double").alias("duration"),
        local_time("timestamp", zone).alias("game_time"),
    )
    return numbered(typed.orderBy(*best_first(F.col("coins"), F.col("duration"))).limit(limit))


def numbered(best: DataFrame) -> DataFrame:
    """The best games with their places."""
    order = best_first(F.col("coins"), F.col("duration"))
    return best.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        "player_name",
        "final_level",
        "coins",
        F.round("duration", 1).alias("duration_seconds"),
        "game_time",
    )
