"""The stored layer that dashboards read.

A folder holds the event table by service, type and day, the live tables, and tables by minute. Newest-first lists open the
newest days until they are full; counts come from file footers; distinct counts and best games of a range of time come from
the minutes. Times that a plan needs, such as "now", are looked up first and stand in it as values, so that folders are pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.functions.predicates import known_player, last
from playlens.functions.timefns import boundary_diff, local_text, local_time
from playlens.operators import leaderboard, minutes, projections
from playlens.plans import feeds
from playlens.sources import event_table as records
from playlens.sources.day_table import DAY, DayTable, footer_counts
from playlens.sources.live_store import day_table, refresh_live_tables, scan_live_table, version_path, write_live_table
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE, DEFAULT_ZONE

TICK = timedelta(microseconds=1)
#: Columns of the ids that are counted by minute.
COUNTED_IDS = ("session_id", "player_name")
RECORD_FOLDERS = ("service", "record_type", DAY)
#: The times that a live table covers.
TIMES = {
    "game_events": ("timestamp", "timestamp"),
    "event_timeline": ("minute", "minute"),
    "player_sessions": ("session_start", "session_end"),
}


@dataclass
class LiveLayer:
    """The layer as it is when a table is first read; ``reopen`` shows what was written since."""

    spark: SparkSession
    folder: str
    service: str = DEFAULT_SERVICE
    limit: int = 20  # games that each minute keeps
    _opened: dict = field(default_factory=dict, repr=False)

    # --- building

    def append_records(self, event_table: DataFrame) -> None:
        """Add records of the event table."""
        records.write_event_table(event_table, f"{self.folder}/records", by_service=True)
        self.reopen()

    def refresh(self, prefix: str = DEFAULT_PREFIX) -> None:
        """Rebuild the live tables and the tables by minute from the stored records."""
        spans = self.records("SPAN").rows()
        refresh_live_tables(projections.game_events(spans, service=None, prefix=prefix), self.folder)
        self.reopen()
        events = self.table("game_events")
        write_live_table(minutes.minute_activity(events), f"{self.folder}/minute_activity", ("minute",))
        write_live_table(minutes.minute_scores(events, self.limit), f"{self.folder}/minute_scores", ("minute",))
        for column in COUNTED_IDS:
            write_live_table(minutes.id_numbers(events, column), f"{self.folder}/numbers_{column}", ("number",))
            numbers = self.table(f"numbers_{column}")
            write_live_table(minutes.minute_ids(events, numbers, column), f"{self.folder}/minute_{column}", ("minute", "bucket"))

    # --- reading

    def _once(self, name: tuple, make: Callable):
        if name not in self._opened:
            self._opened[name] = make()
        return self._opened[name]

    def reopen(self) -> None:
        """Read the newest versions from now on."""
        self._opened.clear()

    def records(self, *record_type: str) -> DayTable:
        """The stored records of the service, of one type if it is given."""
        fixed = (("service", self.service), *(("record_type", name) for name in record_type))
        return self._once(("records", *record_type), lambda: self._stored(fixed))

    def _stored(self, fixed: tuple[tuple[str, str], ...] = ()) -> DayTable:
        return DayTable(self.spark, f"{self.folder}/records", fixed, folders=RECORD_FOLDERS[:-1])

    def table(self, name: str) -> DataFrame:
        return self._once((name,), lambda: scan_live_table(self.spark, self.folder, name))

    @property
    def events(self) -> DayTable:
        return self._once(("events", "days"), lambda: day_table(self.spark, self.folder))

    def by_minute(self) -> minutes.MinuteTables:
        ids = lambda name: (self.table(f"numbers_{name}"), self.table(f"minute_{name}"))
        return minutes.MinuteTables(lambda: self.table("minute_activity"), ids, lambda: self.table("minute_scores"), self.events.between)

    def _range(self, as_of: datetime | None, hours: int | None, *, strict: bool = False) -> tuple[datetime, datetime]:
        """The last ``hours`` before ``as_of`` as a range from its start to before its end; an empty one if there is no event.

        Nothing is newer than the newest event or older than the oldest, so these ends are moved to whole minutes.
        """
        latest = self.events.latest_time
        if latest is None:
            return datetime.min, datetime.min
        end = as_of + TICK if as_of else minutes.floor(latest) + minutes.MINUTE
        if hours is None:
            return minutes.floor(self.events.first_time), end
        return (as_of or latest) - timedelta(hours=hours) + TICK * strict, end

    # --- answers

    def newest(self, limit: int) -> DataFrame:
        return self.events.newest(limit)

    def event_feed(self, *, limit: int = 500, player: str | None = None, zone: str = DEFAULT_ZONE, as_text: bool = False) -> DataFrame:
        return feeds.shown_feed(self.events.newest(limit, lambda rows: feeds.fed(rows, player)), zone=zone, as_text=as_text)

    def view_newest(self, limit: int) -> DataFrame:
        """The newest events as the view over the stored records shows them."""
        return self.records("SPAN").newest(limit, lambda rows: projections.game_events(rows, service=None))

    def latest_raw_span(self) -> DataFrame:
        """The newest span as it is stored."""
        rows = self.records("SPAN").newest(1, lambda rows: feeds.raw_span(rows, "event_id"))
        return rows.drop("event_id")

    def _of_all(self, record_type: str) -> DayTable:
        """The stored records of one type and all services."""
        return self._once(("all", record_type), lambda: self._stored((("record_type", record_type),)))

    def recent_spans(self, *, minutes: int = 5, limit: int = 25) -> DataFrame:
        """The newest game spans of any service."""
        table = self._of_all("SPAN")
        return feeds.recent_spans(table.last(minutes=minutes), as_of=table.latest_time, minutes=minutes, limit=limit)

    def recent_logs(self, *, minutes: int = 10, limit: int = 20) -> DataFrame:
        """The newest log lines of any service."""
        table = self._of_all("LOG")
        return feeds.recent_logs(table.last(minutes=minutes), as_of=table.latest_time, minutes=minutes, limit=limit)

    def spans_of_last(self, *, hours: int = 0, minutes: int = 0, strict: bool = False) -> DataFrame:
        """Game spans of the last ``hours`` and ``minutes`` before the newest one."""
        table = self.records("SPAN")
        spans = projections.spans(table.last(hours=hours, minutes=minutes), service=None)
        return last(spans, hours=hours, minutes=minutes, as_of=table.latest_time or datetime.min, strict=strict)

    def recent_sessions(self, *, limit: int = 50, player: str | None = None) -> DataFrame:
        return feeds.shown_sessions(self.events.newest(limit, lambda rows: feeds.finished(rows, player)))

    def leaderboard(
        self, *, as_of: datetime | None = None, hours: int | None = 24, zone: str = DEFAULT_ZONE, as_text: bool = False
    ) -> DataFrame:
        """The best games of known players, from the best of each minute."""
        best = self.by_minute().best_games(self.limit, *self._range(as_of, hours))
        shown = local_text("timestamp", zone) if as_text else local_time("timestamp", zone)
        return leaderboard.numbered(best.withColumn("game_time", shown))

    def activity_summary(self, *, as_of: datetime | None = None, hours: int | None = None) -> DataFrame:
        """Events, sessions and event types of the last ``hours``, or of all time."""
        return self.by_minute().summary(*self._range(as_of, hours))

    def unique_players(self, *, as_of: datetime | None = None, hours: int | None = 1) -> DataFrame:
        """Known players of the last ``hours``."""
        return self.by_minute().distinct_ids("player_name", *self._range(as_of, hours, strict=True)).where(known_player())

    def record_type_counts(self) -> DataFrame:
        """Records of the service by type, from the footers."""
        counts = footer_counts(self.spark, f"{self.folder}/records", RECORD_FOLDERS, "service", "record_type")
        own = counts.where(F.col("service") == self.service)
        return own.select("record_type", F.col("total").alias("total_records")).orderBy(F.desc("total_records"))

    def _rows_of(self, name: str) -> int:
        """Rows of a live table, from the footers."""
        if name == "game_events":
            return self.events.count()
        path = version_path(self.spark, self.folder, name)
        return footer_counts(self.spark, path, (), columns=self.table(name).schema.json()).first().total

    def freshness(self) -> DataFrame:
        """The newest live event and its age at the newest record of any service."""
        records = self._once(("records", "of all services"), lambda: self._stored())
        return self._aged(records.latest_time)

    def _aged(self, now: datetime | None) -> DataFrame:
        times = self.spark.createDataFrame([(self.events.latest_time, now)], "latest_event timestamp_ntz, now timestamp_ntz")
        return times.withColumn("minutes_since_last_event", boundary_diff("MINUTE", "latest_event", "now")).drop("now")

    def health_check(self) -> DataFrame:
        """Row counts and freshness of every layer, in one row. Only the pressed keys are read."""
        counts = {
            "total_event_table_rows": self.records().count(),
            "live_table_rows": self._rows_of("game_events"),
            "active_sessions": self._rows_of("player_sessions"),
            "levels_with_deaths": self._rows_of("deaths_by_level"),
        }
        keys = self.table("key_presses").agg(F.sum("presses")).scalar()
        row = self._aged(self.records().latest_time)
        return row.select("*", *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()], keys.alias("total_key_presses"))

    def profile(self) -> DataFrame:
        """One row per live table: rows, and the time range where it has one. Rows come from the footers."""
        rows = []
        for seq, name in enumerate(("game_events", "event_timeline", "key_presses", "deaths_by_level", "powerups", "player_sessions"), start=1):
            first = latest = None
            if name == "game_events":
                first, latest = self.events.first_time, self.events.latest_time
            elif name in TIMES:
                low, high = TIMES[name]
                first, latest = self.table(name).agg(F.min(low), F.max(high)).first()
            rows.append((seq, name, self._rows_of(name), first, latest))
        schema = "seq bigint, table_name string, total_rows bigint, first_time timestamp_ntz, last_time timestamp_ntz"
        return self.spark.createDataFrame(rows, schema).orderBy("seq")
