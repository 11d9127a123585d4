"""Live tables kept fresh from a stream.

Every live aggregate can be merged from partial aggregates: counts and sums add up, minima and
maxima combine. So each micro-batch is grouped on its own and merged into the stored table, of which
only the buckets that hold its keys are rewritten. Nothing is kept in a state store, a late
event counts whenever it comes, a batch that runs again after a failure changes nothing, and what a
reader reads does not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playlens.functions.predicates import not_event
from playlens.functions.timefns import boundary_diff
from playlens.operators import aggregates
from playlens.operators.aggregates import session_duration_histogram
from playlens.operators.projections import game_events
from playlens.sources.stored import KeyedTable, Log
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE

NAMES = ("event_timeline", "key_presses", "deaths_by_level", "powerups", "player_sessions")
EVERY_MINUTE = {"processingTime": "1 minute"}


@dataclass(frozen=True)
class RunningTable:
    """A grouped table, how partial results of each column combine, and the expressions that choose a row's bucket."""

    build: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    spread: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    lows: tuple[str, ...] = ()
    highs: tuple[str, ...] = ()
    finish: Callable[[DataFrame], DataFrame] = lambda stored: stored

    def merges(self) -> dict[str, Column]:
        """How rows of one key become one row."""
        return (
            {name: F.sum(name) for name in self.sums}
            | {name: F.min(name) for name in self.lows}
            | {name: F.max(name) for name in self.highs}
        )


def _with_duration(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("duration_seconds", boundary_diff("SECOND", "session_start", "session_end"))


RUNNING_TABLES = {
    # The minutes of a batch lie in a few hours, so it touches a few buckets.
    "event_timeline": RunningTable(
        aggregates.event_timeline,
        ("minute", "event_type"),
        spread=("date_trunc('HOUR', minute)",),
        sums=("event_count",),
    ),
    "key_presses": RunningTable(aggregates.key_presses, ("player_name", "key_name"), sums=("presses",)),
    "deaths_by_level": RunningTable(aggregates.deaths_by_level, ("player_name", "level"), sums=("deaths",)),
    "powerups": RunningTable(aggregates.powerups, ("player_name", "powerup_type", "level"), sums=("count",)),
    "player_sessions": RunningTable(
        aggregates.player_sessions,
        ("player_name", "session_id"),
        sums=("deaths", "coins", "levels_won"),
        lows=("session_start",),
        highs=("session_end", "highest_level"),
        finish=_with_duration,
    ),
    "counters": RunningTable(aggregates.counters, ("instrument", "label_1", "label_2"), sums=("total",)),
    "session_duration": RunningTable(
        session_duration_histogram,
        ("bucket",),
        sums=("total", "sum_duration"),
        lows=("min_duration",),
        highs=("max_duration",),
    ),
}


def stored_table(path: str, table: RunningTable) -> KeyedTable:
    """Where a running table is kept."""
    return KeyedTable(path, table.keys, table.spread)


def stream_table(
    source: DataFrame, table: RunningTable, *, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep one live aggregate fresh."""
    stored = stored_table(path, table)
    return (
        source.writeStream.foreachBatch(lambda batch, number: stored.upsert(table.build(batch), number, table.merges()))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_MINUTE))
        .start()
    )


def stream_game_events(
    source: DataFrame, *, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append flat events, exactly once."""
    return (
        source.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_MINUTE))
        .start()
    )


def stream_live_tables(
    source: DataFrame,
    *,
    folder: str,
    checkpoint: str,
    names: tuple[str, ...] = NAMES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """All six live tables from one pass over the stream.

    A micro-batch is projected once, into the log of ``game_events``; the aggregates read the columns they need from there.
    Each table is committed on its own, the log first: a batch that fails between two of them goes on with the next.
    """
    log = Log(f"{folder}/game_events")

    def write(batch: DataFrame, number: int) -> None:
        log.append(batch, number)
        events = log.read_batch(batch.sparkSession, number)
        for name in names:
            table = RUNNING_TABLES[name]
            stored_table(f"{folder}/{name}", table).upsert(table.build(events), number, table.merges())

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_MINUTE))
        .start()
    )


def refresh_new_files(
    spark: SparkSession,
    records: str,
    folder: str,
    *,
    service: str | None = DEFAULT_SERVICE,
    prefix: str = DEFAULT_PREFIX,
    names: tuple[str, ...] = NAMES,
) -> StreamingQuery:
    """Bring the live tables in ``folder`` up to date with the files that came to the event table since the last call.

    The event table is read as a stream that ends with its present files; the checkpoint in ``folder`` knows which were read.
    What they hold is merged into the tables, so a refresh costs what is new, not what there is.
    """
    table = spark.readStream.schema(spark.read.parquet(records).schema).parquet(records)
    events = game_events(table, service=service, prefix=prefix)
    query = stream_live_tables(
        events, folder=folder, checkpoint=f"{folder}/checkpoint", names=names, trigger={"availableNow": True}
    )
    query.awaitTermination()
    return query


def read_live(spark: SparkSession, path: str, table: RunningTable) -> DataFrame:
    """The content of a streamed table as of its last committed batch."""
    return table.finish(stored_table(path, table).read(spark))


def read_live_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of ``stream_live_tables`` up to its last committed batch."""
    return Log(f"{folder}/game_events").read(spark)


def closed_minutes(source: DataFrame, *, watermark: str = "10 minutes") -> DataFrame:
    """The event timeline as an append-only stream: a minute appears once when it can no longer
    change, that is when the watermark has passed it."""
    timed = source.where(not_event("key_press")).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")
    )
    return (
        timed.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 minute").alias("w"), "event_type")
        .agg(F.count("*").alias("event_count"))
        .select(F.col("w.start").alias("minute"), "event_type", "event_count")
    )
