"""Tables by minute from which exact answers over any range of time follow without reading the events.

* Distinct ids: ids are numbered in the order in which they first came, and each minute has bitmaps of the numbers seen in it.
  Bitmaps merge by OR, so distinct counts of minutes combine exactly. Ids of one time have numbers near one another, so a
  minute has few bitmaps. A bitmap holds only its words of 64 numbers that are not empty: it is never larger than the ids it
  came from, however few of them fall into a minute.
* Best games: each minute has its ``limit`` best rows in an array. The best of a range are among those of its minutes.
* Counts: events and event types of each minute.

A range that begins or ends inside a minute takes that minute's part from the events themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.predicates import is_event, known_player
from playlens.functions.timefns import slice_minutes
from playlens.operators.leaderboard import best_first
from playlens.operators.ordered import global_rank

MINUTE = timedelta(minutes=1)
#: A bitmap covers two to this power of words.
BUCKET_BITS = 9


def _minute() -> Column:
    return slice_minutes("timestamp").alias("minute")


def minute_activity(events: DataFrame) -> DataFrame:
    """(minute, events, event_types): events of each minute, and the types among them."""
    return events.groupBy(_minute()).agg(F.count("*").alias("events"), F.collect_set("event_type").alias("event_types"))


def id_numbers(events: DataFrame, column: str) -> DataFrame:
    """(id, number): the ids of ``column`` numbered from 1 as they came."""
    firsts = (
        events.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("id"))
        .agg(F.min("timestamp").alias("first"))
    )
    return global_rank(firsts, [F.col("first").asc_nulls_first(), "id"], "number").select("id", "number")


def _words(rows: DataFrame, numbers: DataFrame, column: str, *keys: Column | str) -> DataFrame:
    """(*keys, word, bits): the numbers seen, 64 to a word. Words are sums of bits, so tasks merge theirs before the shuffle."""
    pairs = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("id")).distinct()
    names = [name for name in pairs.columns if name != "id"]
    word, bit = F.shiftright("number", 6), F.col("number").bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return pairs.join(numbers, "id").groupBy(*names, word.alias("word")).agg(F.bit_or(one).alias("bits"))


def minute_ids(events: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    """(minute, bucket, words): the numbers of the ids of each minute, a row for each ``2 ** BUCKET_BITS`` words that are not all empty."""
    words = _words(events, numbers, column, _minute())
    bucket = F.shiftright("word", BUCKET_BITS).alias("bucket")
    return words.groupBy("minute", bucket).agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def finished_games(events: DataFrame) -> DataFrame:
    """Finished games of known players, typed."""
    return events.where(is_event("game_over") & known_player()).select(
        "event_id",
        "timestamp",
        "player_name",
        F.col("level").alias("final_level"),
        F.col("coins").try_cast("int").alias("coins"),
        F.col("duration").try_cast("double").alias("duration"),
    )


def minute_scores(events: DataFrame, limit: int = 20) -> DataFrame:
    """(minute, best): the ``limit`` best games of each minute. Tasks cut their rows to that many before the shuffle."""
    best = Window.partitionBy("minute").orderBy(*best_first(F.col("coins"), F.col("duration")))
    games = finished_games(events).withColumn("minute", slice_minutes("timestamp"))
    ranked = games.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return ranked.groupBy("minute").agg(F.collect_list(F.struct(*[name for name in games.columns if name != "minute"])).alias("best"))


def floor(time: datetime) -> datetime:
    return time.replace(second=0, microsecond=0)


def whole_minutes(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The first and the end of the whole minutes from ``start`` to before ``end``."""
    first = floor(start) if floor(start) == start else floor(start) + MINUTE
    return first, max(first, floor(end))


@dataclass(frozen=True)
class MinuteTables:
    """Answers for ranges from ``start`` to before ``end``. Tables are opened when they are asked for.

    ``ids(column)`` gives the numbers and the bitmaps of minutes, ``events(start, end)`` the events of a part of a minute.
    """

    activity: Callable[[], DataFrame]
    ids: Callable[[str], tuple[DataFrame, DataFrame]]
    scores: Callable[[], DataFrame]
    events: Callable[[datetime, datetime], DataFrame]

    def _inside(self, table: DataFrame, start: datetime, end: datetime) -> DataFrame:
        first, last = whole_minutes(start, end)
        kind = table.schema["minute"].dataType
        bound = lambda value: F.lit(value.isoformat(sep=" ")).cast(kind)
        return table.where((F.col("minute") >= bound(first)) & (F.col("minute") < bound(last)))

    def _edges(self, start: datetime, end: datetime) -> DataFrame | None:
        """Events of the range outside its whole minutes; None if there are no such parts."""
        first, last = whole_minutes(start, end)
        if first > end:  # within one minute
            return self.events(start, end)
        parts = [self.events(a, b) for a, b in ((start, first), (last, end)) if a < b]
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def _numbers_seen(self, column: str, start: datetime, end: datetime) -> DataFrame:
        """(word, bits) of the numbers seen."""
        numbers, bitmaps = self.ids(column)
        rows, edges = self._inside(bitmaps, start, end).select(F.inline("words")), self._edges(start, end)
        if edges is not None:
            rows = rows.unionByName(_words(edges, numbers, column))
        return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def distinct_count(self, column: str, start: datetime, end: datetime) -> DataFrame:
        """One row: how many ids were seen."""
        seen = self._numbers_seen(column, start, end)
        return seen.agg(F.coalesce(F.sum(F.bit_count("bits").cast("bigint")), F.lit(0)).alias("ids"))

    def distinct_ids(self, column: str, start: datetime, end: datetime) -> DataFrame:
        """The ids that were seen."""
        bits = self._numbers_seen(column, start, end).select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        number = F.col("word") * 64 + F.col("bit")
        seen = bits.where(F.expr("getbit(bits, bit) = 1")).select(number.alias("number"))
        return seen.join(self.ids(column)[0], "number").select(F.col("id").alias(column))

    def summary(self, start: datetime, end: datetime) -> DataFrame:
        """One row: events, sessions and event types."""
        minutes, edges = self._inside(self.activity(), start, end).select("events", "event_types"), self._edges(start, end)
        if edges is not None:
            minutes = minutes.unionByName(edges.agg(F.count("*").alias("events"), F.collect_set("event_type").alias("event_types")))
        types = minutes.select(F.explode("event_types").alias("event_type")).agg(F.count_distinct("event_type"))
        return minutes.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total_events")).select(
            "total_events",
            self.distinct_count("session_id", start, end).scalar().alias("unique_sessions"),
            types.scalar().alias("event_types"),
        )

    def best_games(self, limit: int, start: datetime, end: datetime) -> DataFrame:
        """The best games of a range, best first; at most as many as the minutes keep."""
        games = self._inside(self.scores(), start, end).select(F.inline("best"))
        edges = self._edges(start, end)
        if edges is not None:
            games = games.unionByName(finished_games(edges))
        return games.orderBy(*best_first(F.col("coins"), F.col("duration"))).limit(limit)
