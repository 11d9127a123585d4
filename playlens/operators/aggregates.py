"""Aggregates over game events.

Every function groups with a map-side partial aggregate, so a key that holds much of the data
reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.predicates import is_event, known_player, last, not_event
from playlens.functions.timefns import boundary_diff, local_time, slice_minutes
from playlens.vocabulary import DEFAULT_ZONE, HISTOGRAM_BOUNDS


def count_of(event: str) -> Column:
    return F.count(F.when(is_event(event), 1))


def player_stats(spans: DataFrame) -> DataFrame:
    """Totals per player over all games."""
    return spans.groupBy("player_name").agg(
        count_of("game_start").alias("total_games"),
        count_of("death").alias("total_deaths"),
        count_of("coin").alias("total_coins_collected"),
        count_of("level_start").alias("total_level_attempts"),
        count_of("level_win").alias("total_level_wins"),
        count_of("game_win").alias("total_game_wins"),
        count_of("powerup_spawn").alias("total_powerups"),
        count_of("key_press").alias("total_key_presses"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
    )


def event_timeline(spans: DataFrame) -> DataFrame:
    """Events per minute and type, without key presses."""
    return (
        spans.where(not_event("key_press"))
        .select(slice_minutes("timestamp").alias("minute"), "event_type")
        .groupBy("minute", "event_type")
        .agg(F.count("*").alias("event_count"))
    )


def key_presses(spans: DataFrame) -> DataFrame:
    return spans.where(is_event("key_press")).groupBy("player_name", "key_name").agg(F.count("*").alias("presses"))


def deaths_by_level(spans: DataFrame) -> DataFrame:
    return spans.where(is_event("death")).groupBy("player_name", "level").agg(F.count("*").alias("deaths"))


def powerups(spans: DataFrame) -> DataFrame:
    return (
        spans.where(is_event("powerup_spawn"))
        .groupBy("player_name", "powerup_type", "level")
        .agg(F.count("*").alias("count"))
    )


def player_sessions(spans: DataFrame) -> DataFrame:
    """Summary per player and session id. ``highest_level`` is the largest level text."""
    return (
        spans.where(F.col("session_id").isNotNull())
        .groupBy("player_name", "session_id")
        .agg(
            F.min("timestamp").alias("session_start"),
            F.max("timestamp").alias("session_end"),
            count_of("death").alias("deaths"),
            count_of("coin").alias("coins"),
            count_of("level_win").alias("levels_won"),
            F.max("level").alias("highest_level"),
        )
        .select(
            "player_name",
            "session_id",
            "session_start",
            "session_end",
            boundary_diff("SECOND", "session_start", "session_end").alias("duration_seconds"),
            "deaths",
            "coins",
            "levels_won",
            "highest_level",
        )
    )


def record_type_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("record_type").agg(F.count("*").alias("total_records")).orderBy(F.desc("total_records"))


def metric_inventory(metrics: DataFrame) -> DataFrame:
    return (
        metrics.groupBy("metric_name")
        .agg(
            F.count("*").alias("data_points"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
        .orderBy(F.desc("data_points"), "metric_name")
    )


def event_distribution(spans: DataFrame, *, as_of=None, hours: int = 1) -> DataFrame:
    """Events per type in the last ``hours``."""
    return (
        last(spans, hours=hours, as_of=as_of, strict=True)
        .groupBy("event_type")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), "event_type")
    )


def unique_players(spans: DataFrame, *, as_of=None, hours: int | None = 1) -> DataFrame:
    """Known players of the last ``hours``, or of all time."""
    return last(spans, hours=hours, as_of=as_of, strict=True).where(known_player()).select("player_name").distinct()


def players_list(game_events: DataFrame, *, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Known players with their number of starts and the local time they were last seen."""
    return (
        game_events.where(known_player())
        .groupBy("player_name")
        .agg(count_of("game_start").alias("sessions"), F.max("timestamp").alias("last_seen"))
        .withColumn("last_seen", local_time("last_seen", zone))
        .orderBy(F.desc("sessions"), "player_name")
    )


# --- instruments --------------------------------------------------------------

UNLABELLED = {
    "game_start": "game.start",
    "game_win": "game.win",
    "game_over": "game.over",
    "coin": "coin.collect",
}


def _label(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("?"))


def counter_events(spans: DataFrame) -> DataFrame:
    """The four counters without labels."""
    return (
        spans.where(is_event(*UNLABELLED))
        .groupBy("event_type")
        .agg(F.count("*").alias("total"))
    )


def labelled_counter(spans: DataFrame, event: str, *labels: str) -> DataFrame:
    """Count of one event per label; a missing label counts under ``?``."""
    return (
        spans.where(is_event(event))
        .groupBy(*[_label(label).alias(label) for label in labels])
        .agg(F.count("*").alias("total"))
    )


INSTRUMENTS = {
    **{event: (name, None, None) for event, name in UNLABELLED.items()},
    "death": ("game.death", "level", None),
    "level_win": ("level.win", "level", None),
    "level_start": ("level.start", "level", "difficulty"),
    "key_press": ("key.press", "key_name", None),
    "powerup_spawn": ("powerup.spawn", "powerup_type", None),
}


def counted(attributes: DataFrame) -> DataFrame:
    """The events that a counter counts, with (instrument, label_1, label_2)."""
    name = first = second = None
    for event, (instrument, label_1, label_2) in INSTRUMENTS.items():
        here = is_event(event)
        name = F.when(here, instrument) if name is None else name.when(here, instrument)
        for label, position in ((label_1, 1), (label_2, 2)):
            if label and position == 1:
                first = F.when(here, _label(label)) if first is None else first.when(here, _label(label))
            elif label:
                second = F.when(here, _label(label)) if second is None else second.when(here, _label(label))
    return attributes.where(is_event(*INSTRUMENTS)).withColumns({"instrument": name, "label_1": first, "label_2": second})


def counters(attributes: DataFrame) -> DataFrame:
    """All nine counters in one pass: (instrument, label_1, label_2, total)."""
    return counted(attributes).groupBy("instrument", "label_1", "label_2").agg(F.count("*").alias("total"))


def duration_buckets(attributes: DataFrame, bounds=HISTOGRAM_BOUNDS, event: str = "session_end", *, also: tuple[str, ...] = ()):
    """One row per recorded duration: (bucket, duration), and the columns ``also`` of the event.

    ``bucket`` is the number of bounds below the value, so bounds are inclusive at the top.
    """
    duration = F.coalesce("duration", "session_duration", F.lit(0.0))
    bucket = sum(((F.col("duration") > bound).cast("int") for bound in bounds), F.lit(0))
    return attributes.where(is_event(event)).select(duration.alias("duration"), *also).withColumn("bucket", bucket)


def session_duration_histogram(attributes: DataFrame, bounds=HISTOGRAM_BOUNDS, event: str = "session_end"):
    """Recorded durations per bucket, with count, sum, min and max of each."""
    return (
        duration_buckets(attributes, bounds, event)
        .groupBy("bucket")
        .agg(
            F.count("*").alias("total"),
            F.sum("duration").alias("sum_duration"),
            F.min("duration").alias("min_duration"),
            F.max("duration").alias("max_duration"),
        )
    )
