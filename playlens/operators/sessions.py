"""Game sessions rebuilt from the global timeline.

A session opens at a game start and ends at the first game over strictly between it and the next
start. A session without such a game over stays open and covers everything up to ``as_of``.
Deaths and level starts from the start to the end, both included, belong to it.

Joining events to sessions on time would compare every event with every open session. Instead
starts, game overs, deaths and level starts are put in one global order and each row learns, from
running totals in that order, the session it falls in and whether that session was over already:

* the session number is the number of starts so far;
* a session is over if the latest game over is later than the latest start;
* what an open session sees is a total counted from the end of the timeline.

The timeline is that of all players, or one per player; totals of a player are then carried from range to range.

What is left for each session is its start, its end and its levels, joined by session number. All
rows are shuffled by time range only, and levels are counted with a map-side combine, so neither one
session nor one player that holds a large part of all events is a hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.predicates import is_event
from playlens.functions.timefns import moment
from playlens.operators.ordered import global_lead, global_rank, ordered_layout, segment_running
from playlens.session import materialise
from playlens.vocabulary import FIRST_LEVEL

# Order of rows with equal time: a start counts what happens at its own instant, and a game over
# does not end what happens at its own instant.
START, POINT, OVER = 0, 1, 2


def _timeline(spans: DataFrame, as_of, keys: list[str]) -> DataFrame:
    """Starts, game overs, deaths and level starts; ``keys`` may ask for the player."""
    kind = F.when(is_event("game_start"), START).when(is_event("game_over"), OVER).otherwise(POINT)
    what = (
        F.when(is_event("game_start"), "start")
        .when(is_event("game_over"), "over")
        .when(is_event("death"), "death")
        .otherwise("level")
    )
    seen = F.lit(True) if as_of is None else F.col("timestamp") <= moment(spans, as_of)
    return spans.where(is_event("game_start", "game_over", "death", "level_start")).select(
        *[F.col("player_name").alias(key) for key in keys],
        "timestamp",
        kind.alias("kind"),
        "event_id",
        what.alias("what"),
        seen.alias("seen"),
        "level",
        F.when(is_event("game_start"), F.struct("player_name", "lives")).alias("opening"),
        F.when(is_event("game_over"), F.struct("coins", "session_duration")).alias("closing"),
    )


def _is(what: str) -> Column:
    return F.col("what") == what


def _last_starts(layout: DataFrame, keys: list[str]) -> DataFrame:
    """Where in the order each level was started last: one row per level, and player if there are ``keys``."""
    return (
        layout.where(_is("level") & F.col("seen") & F.col("level").isNotNull())
        .groupBy(*keys, "level")
        .agg(F.max(F.struct("part", "pos")).alias("place"))
        .select(*keys, "level", "place.part", "place.pos", F.lit("last").alias("what"))
    )


def _running(layout: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the totals up to it and those from it to the end of the timeline."""
    start_time = F.when(_is("start"), F.col("timestamp"))
    over_time = F.when(_is("over"), F.col("timestamp"))

    def count(condition: Column) -> tuple[str, Column]:
        return "sum", F.when(condition, 1).otherwise(0).cast("bigint")

    return segment_running(
        layout,
        keys,
        so_far={
            "session_id": count(_is("start")),
            "deaths": count(_is("death")),
            "levels": count(_is("level")),
            "last_start": ("max", start_time),
        },
        until={"last_over": ("max", over_time)},
        from_here={
            "deaths_after": count(_is("death") & F.col("seen")),
            "level_rows_after": count(_is("level") & F.col("seen")),
            # A session that stays open plays the levels whose last start comes after its own start.
            "levels_after": count(_is("last")),
            "top_level_after": ("max", F.when(_is("last"), F.col("level"))),
        },
    )


def session_core(spans: DataFrame, *, as_of=None, partition_by_player: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per game start with everything known about its session.

    With ``partition_by_player`` every player has a timeline: starts are numbered from 1 for each player, and only events of
    the player count. Events without a player are those of one more player.
    """
    keys = ["player"] if partition_by_player else []
    timeline = _timeline(spans, as_of, keys)
    order = [*[F.col(key).asc_nulls_first() for key in keys], "timestamp", "kind", "event_id"]
    layout = ordered_layout(timeline, order, partitions=partitions)
    running = F.col("last_over").isNull() | (F.col("last_over") <= F.col("last_start"))
    ends = _is("over") & (F.col("timestamp") > F.col("last_start"))

    # Kept: starts, the first game over of each session, and levels started before it. Deaths were
    # counted on the way. Stored, because three inputs of the joins below come from it.
    rows = materialise(
        _running(layout.unionByName(_last_starts(layout, keys), allowMissingColumns=True), keys)
        .where((F.col("session_id") > 0) & (_is("start") | (running & (ends | _is("level")))))
        .drop("part", "pos", "kind", "event_id", "seen", "last_start", "last_over"),
        "sessions",
    )
    opened = rows.where(_is("start")).drop("what", "level", "closing")
    closed = rows.where(_is("over")).select(
        *keys, "session_id", F.struct("timestamp", "level", "closing", "deaths", "levels").alias("e")
    )
    played = (
        rows.where(_is("level") & F.col("level").isNotNull())
        .groupBy(*keys, "session_id", "level")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys, "session_id")
        .agg(F.count("level").alias("levels_in"), F.max("level").alias("top_level_in"))
    )
    joined = _beside(_beside(opened, closed, [*keys, "session_id"]), played, [*keys, "session_id"])
    ended = F.col("e").isNotNull()
    return joined.select(
        "session_id",
        F.col("opening.player_name").alias("player_name"),
        F.col("opening.lives").alias("starting_lives"),
        F.col("timestamp").alias("session_start"),
        F.col("e.timestamp").alias("session_end"),
        F.col("e.level").alias("final_level"),
        F.col("e.closing.coins").alias("final_coins"),
        F.col("e.closing.session_duration").alias("duration_seconds"),
        F.when(ended, F.col("e.deaths") - F.col("deaths")).otherwise(F.col("deaths_after")).alias("total_deaths"),
        F.when(ended, F.col("e.levels") - F.col("levels")).otherwise(F.col("level_rows_after")).alias("level_rows"),
        F.when(ended, F.coalesce("levels_in", F.lit(0))).otherwise(F.col("levels_after")).alias("levels_played"),
        F.when(ended, F.col("top_level_in")).otherwise(F.col("top_level_after")).alias("highest_level"),
    )


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of the row of ``right`` that has the same keys, missing ones included."""
    renamed = right.withColumnsRenamed({key: f"right_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"right_{key}"))
    return left.join(renamed, same, "left").drop(*[f"right_{key}" for key in keys])


def session_match(spans: DataFrame, core: DataFrame) -> DataFrame:
    """Each start with the next one and with the game over that ends its session, or none."""
    following = session_next_start(session_ids(spans)).select("session_id", "next_session_start")
    return core.join(following, "session_id").select(
        "session_id",
        "session_start",
        "player_name",
        "starting_lives",
        "next_session_start",
        "session_end",
        "final_level",
        "final_coins",
        "duration_seconds",
    )


def session_deaths(core: DataFrame) -> DataFrame:
    return core.where(F.col("total_deaths") > 0).select("session_id", "total_deaths")


def session_levels(core: DataFrame) -> DataFrame:
    return core.where(F.col("level_rows") > 0).select("session_id", "levels_played", "highest_level")


def session_enrich(matched: DataFrame, deaths: DataFrame, levels: DataFrame) -> DataFrame:
    """Matched sessions with their deaths and levels, and defaults for those without."""
    return _report(matched.join(deaths, "session_id", "left").join(levels, "session_id", "left"))


def _report(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id",
        "player_name",
        "session_start",
        "session_end",
        F.round("duration_seconds", 1).alias("duration_seconds"),
        "final_level",
        F.col("final_coins").alias("score_coins"),
        F.coalesce("total_deaths", F.lit(0)).alias("total_deaths"),
        F.coalesce("levels_played", F.lit(0)).alias("levels_played"),
        F.coalesce("highest_level", F.lit(FIRST_LEVEL)).alias("highest_level"),
    )


def game_sessions(
    spans: DataFrame, *, as_of=None, partition_by_player: bool = False, partitions: int | None = None
) -> DataFrame:
    """The session report, with defaults for sessions without deaths or levels."""
    return _report(session_core(spans, as_of=as_of, partition_by_player=partition_by_player, partitions=partitions))


def game_starts(spans: DataFrame) -> DataFrame:
    return spans.where(is_event("game_start")).select(
        "event_id", F.col("timestamp").alias("session_start"), "player_name", F.col("lives").alias("starting_lives")
    )


def session_ids(spans: DataFrame) -> DataFrame:
    """Starts numbered in time order."""
    return global_rank(game_starts(spans), ["session_start", "event_id"], "session_id")


def session_next_start(starts: DataFrame) -> DataFrame:
    """Starts with the time of the next one."""
    return global_lead(starts, "session_start", ["session_start", "event_id"], "next_session_start")


def session_averages(sessions: DataFrame) -> DataFrame:
    """One row: averages and ratios over ended sessions, and how many there are (``n``)."""
    seconds = F.sum("duration_seconds")
    return sessions.where(F.col("duration_seconds").isNotNull()).agg(
        F.count("*").alias("n"),
        F.round(F.avg("duration_seconds"), 1).alias("avg_playtime_sec"),
        F.round(F.nullif(seconds, F.lit(0)) / F.nullif(F.sum("total_deaths"), F.lit(0)), 1).alias("avg_sec_per_death"),
        F.round(F.avg("score_coins"), 1).alias("avg_coins_per_round"),
        F.round(F.nullif(seconds, F.lit(0)) / F.nullif(F.sum("levels_played"), F.lit(0)), 1).alias("avg_level_played_sec"),
        F.round(F.avg("levels_played"), 1).alias("avg_attempts_per_game"),
    )


def avg_stats_cross(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Every player's totals beside the averages over ended sessions, which are one row; no row without an ended session."""
    averages = session_averages(sessions)
    packed = averages.select(F.struct(*averages.columns)).scalar()
    return stats.withColumn("s", packed).where(F.col("s.n") > 0).select(*stats.columns, *[f"s.{name}" for name in averages.columns if name != "n"])


def avg_stats(sessions: DataFrame, stats: DataFrame, *, single_row: bool = False) -> DataFrame:
    """Averages over ended sessions next to ratios of the player totals.

    Every session meets every player in the definition. Averages and ratios of sums do not change
    when each session is repeated equally often, so sessions shrink to one row first. There is a
    row per distinct combination of player totals, or one for their sums with ``single_row``; none
    without an ended session.
    """
    totals = ["total_level_wins", "total_level_attempts", "total_key_presses", "total_games"]
    if single_row:
        players = stats.agg(*[F.sum(name).alias(name) for name in totals])
    else:
        players = stats.select(*totals).distinct()
    wins = F.col("total_level_wins").cast("double") / F.nullif("total_level_attempts", F.lit(0))
    keys = F.col("total_key_presses").cast("double") / F.nullif("total_games", F.lit(0))
    return avg_stats_cross(sessions, players).select(
        "avg_playtime_sec",
        "avg_sec_per_death",
        "avg_coins_per_round",
        "avg_level_played_sec",
        "avg_attempts_per_game",
        F.round(wins * 100, 1).alias("win_rate_pct"),
        F.round(keys, 0).alias("avg_keys_per_game"),
    )
