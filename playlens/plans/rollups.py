"""Second-level aggregates over the live tables, and the dashboard totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.labels import event_label
from playlens.functions.predicates import of_player
from playlens.functions.timefns import ago, boundary_diff, now_of
from playlens.operators.aggregates import count_of
from playlens.plans.feeds import timeline
from playlens.vocabulary import TIME_RANGES


def _rollup(table: DataFrame, keys: list[str], measure: str, player: str | None) -> DataFrame:
    return (
        of_player(table, player)
        .groupBy(*keys)
        .agg(F.sum(measure).alias(measure))
        .orderBy(F.desc(measure), *keys)
    )


def deaths_rollup(deaths_by_level: DataFrame, *, player: str | None = None) -> DataFrame:
    return _rollup(deaths_by_level, ["level"], "deaths", player)


def keys_rollup(key_presses: DataFrame, *, player: str | None = None) -> DataFrame:
    return _rollup(key_presses, ["key_name"], "presses", player)


def powerups_rollup(powerups: DataFrame, *, player: str | None = None) -> DataFrame:
    return _rollup(powerups, ["powerup_type", "level"], "count", player)


def kpi_totals(game_events: DataFrame, powerups: DataFrame, *, player: str | None = None) -> DataFrame:
    """Six totals in one pass over the events and one over the powerups.

    The powerup total is NULL when there is none.
    """
    return (
        of_player(game_events, player)
        .agg(
            F.count("*").alias("total_events"),
            count_of("death").alias("total_deaths"),
            count_of("coin").alias("total_coins"),
            count_of("level_win").alias("total_levels_won"),
            count_of("game_start").alias("total_sessions"),
        )
        .withColumn("total_powerups", of_player(powerups, player).agg(F.sum("count")).scalar())
    )


def events_per_range(spans: DataFrame, *, as_of=None) -> DataFrame:
    """Events in each preset time range, all ranges counted in one pass."""
    now = now_of(spans, as_of)
    counts = [
        F.count("*") if minutes is None else F.count(F.when(F.col("timestamp") >= ago(now, minutes=minutes), 1))
        for minutes in TIME_RANGES.values()
    ]
    pairs = [F.struct(F.lit(name).alias("time_range"), n.alias("events")) for name, n in zip(TIME_RANGES, counts)]
    return spans.agg(F.array(*pairs).alias("ranges")).select(F.inline("ranges"))


def recent_event_distribution(feed: DataFrame) -> DataFrame:
    """What the newest events consist of, from a feed of them."""
    return feed.groupBy(event_label().alias("name")).agg(F.count("*").alias("events"))


def timeline_pivot(event_timeline: DataFrame, *, event_types: list[str] | None = None) -> DataFrame:
    """A row per minute and a column per event type, 0 where there was none."""
    labelled = event_timeline.select("minute", event_label().alias("label"), "event_count")
    return labelled.groupBy("minute").pivot("label", event_types).agg(F.sum("event_count")).na.fill(0)


def timeline_pivot_recent(
    event_timeline: DataFrame, *, rows: int = 500, minutes: int = 30, event_types: list[str] | None = None
) -> DataFrame:
    """The pivot over the newest timeline rows, cut to the newest minutes."""
    newest = timeline(event_timeline, limit=rows)
    return timeline_pivot(newest, event_types=event_types).orderBy(F.desc("minute")).limit(minutes)


def event_types(event_timeline: DataFrame) -> DataFrame:
    return event_timeline.select("event_type").distinct()


def health_check(records: DataFrame, live: dict[str, DataFrame], *, as_of=None) -> DataFrame:
    """Row counts and freshness of every layer, in one row."""
    events = live["game_events"]
    summary = events.agg(F.struct(F.count("*").alias("n"), F.max("timestamp").alias("latest")).alias("s"))
    return (
        summary.select(
            records.agg(F.count("*")).scalar().alias("total_event_table_rows"),
            F.col("s.n").alias("live_table_rows"),
            F.col("s.latest").alias("latest_event"),
            now_of(records, as_of).alias("now"),
            live["player_sessions"].agg(F.count("*")).scalar().alias("active_sessions"),
            live["deaths_by_level"].agg(F.count("*")).scalar().alias("levels_with_deaths"),
            live["key_presses"].agg(F.sum("presses")).scalar().alias("total_key_presses"),
        )
        .withColumn("minutes_since_last_event", boundary_diff("MINUTE", "latest_event", "now"))
        .drop("now")
    )


def freshness(game_events: DataFrame, *, as_of=None) -> DataFrame:
    """Newest live event and its age in minutes, at ``as_of`` (such as the newest raw record)."""
    return game_events.agg(F.max("timestamp").alias("latest_event")).withColumn(
        "minutes_since_last_event", boundary_diff("MINUTE", "latest_event", now_of(game_events, as_of))
    )


def live_table_profile(live: dict[str, DataFrame]) -> DataFrame:
    """One row per live table: rows, and the time range where it has one."""
    spans = {
        "game_events": ("timestamp", "timestamp"),
        "event_timeline": ("minute", "minute"),
        "player_sessions": ("session_start", "session_end"),
    }
    time_type = live["game_events"].schema["timestamp"].dataType
    result = None
    for seq, (name, table) in enumerate(live.items(), start=1):
        first, latest = spans.get(name, (None, None))
        row = table.agg(
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit(name).alias("table_name"),
            F.count("*").alias("total_rows"),
            (F.min(first) if first else F.lit(None).cast(time_type)).alias("first_time"),
            (F.max(latest) if latest else F.lit(None).cast(time_type)).alias("last_time"),
        )
        result = row if result is None else result.unionByName(row)
    return result.orderBy("seq")
