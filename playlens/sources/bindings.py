"""Telemetry derived from the given ``events`` table.

``events`` is a click stream (event_id, ts, user_id, event_type, value, props). Each statement
below maps it row by row to one kind of telemetry; the text is valid in Spark and in DuckDB, so
that both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.operators import projections
from playlens.session import materialise
from playlens.sources.event_table import log_records, metric_records, span_records
from playlens.vocabulary import DEFAULT_SERVICE

OTHER_SERVICE = "OTHER_SERVICE"

SPANS = """
SELECT event_id, ts AS timestamp,
 CASE event_type WHEN 'signup' THEN 'game.game_start' WHEN 'error' THEN 'game.death' WHEN 'click' THEN 'game.key_press'
  WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'game.level_start' WHEN 1 THEN 'game.level_win' ELSE 'game.powerup_spawn' END
  ELSE CASE k % 2 WHEN 0 THEN 'game.game_over' ELSE 'game.coin' END END AS event_type,
 CASE WHEN user_id % 25 = 7 THEN NULL WHEN user_id % 10 = 0 THEN 'unknown'
      ELSE concat('player_', cast(user_id as varchar(20))) END AS player_name,
 CASE WHEN event_type IN ('error','view') OR (event_type='purchase' AND k % 2 = 0)
      THEN concat(cast(k % 4 + 1 as varchar(5)), '-', cast(k % 3 + 1 as varchar(5))) END AS level,
 CASE WHEN event_type='error' OR (event_type='view' AND k % 3 <> 2) OR (event_type='purchase' AND k % 2 = 0) THEN k END AS coins,
 CASE WHEN event_type IN ('signup','error') OR (event_type='view' AND k % 3 <> 2) THEN k % 4 END AS lives,
 CASE WHEN event_type='click' THEN CASE k % 6 WHEN 0 THEN 'left' WHEN 1 THEN 'up' WHEN 2 THEN 'right'
      WHEN 3 THEN 'down' WHEN 4 THEN 'A_sprint' ELSE 'S_jump' END END AS key_name,
 CASE WHEN event_type='view' AND k % 3 = 2 THEN CASE k % 2 WHEN 0 THEN 'mushroom' ELSE 'fire_flower' END END AS powerup_type,
 CASE WHEN event_type='purchase' AND k % 2 = 0 THEN value END AS session_duration,
 CASE WHEN event_id % 20 = 0 THEN NULL ELSE concat('s', cast(user_id as varchar(20)), '_', cast(day(ts) as varchar(5))) END AS session_id
FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) as int) AS k FROM {events}) e
"""

METRICS = """
SELECT event_id, ts AS timestamp,
 CASE event_id % 6 WHEN 0 THEN 'container.cpu.usage' WHEN 1 THEN 'container.memory.usage'
  WHEN 2 THEN 'network.ingress.connections.active' WHEN 3 THEN 'network.ingress.cps'
  WHEN 4 THEN 'otel.sdk.span.started' ELSE 'otel.sdk.span.live' END AS metric_name,
 CASE event_id % 6 WHEN 0 THEN value / 500 WHEN 1 THEN value * 1048576 ELSE value END AS metric_value
FROM {events}
"""

#: Metrics of another service: larger, and reported later than anything else.
OTHER_METRICS = """
SELECT event_id, ts + INTERVAL '20' MINUTE AS timestamp,
 CASE event_id % 6 WHEN 0 THEN 'container.cpu.usage' WHEN 1 THEN 'container.memory.usage'
  WHEN 2 THEN 'network.ingress.connections.active' WHEN 3 THEN 'network.ingress.cps'
  WHEN 4 THEN 'otel.sdk.span.started' ELSE 'otel.sdk.span.live' END AS metric_name,
 CASE event_id % 6 WHEN 0 THEN value / 200 WHEN 1 THEN value * 3145728 ELSE value * 3 END AS metric_value
FROM {events} WHERE event_id % 7 = 0
"""

LOGS = """
SELECT event_id, ts AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS severity,
 concat(CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'warning' ELSE 'info' END,
        ' event=', cast(event_id as varchar(20))) AS log_message
FROM {events}
"""

REQUESTS = """
SELECT event_id, ts, CASE WHEN user_id % 10 = 3 THEN concat(' user_', cast(user_id as varchar(20)), ' ') ELSE '' END AS user_header,
 concat(CASE WHEN event_id % 40 = 1 THEN '/whoami' ELSE '/telemetry' END, '?',
   CASE WHEN event_id % 40 = 2 THEN '' ELSE concat('d=',
   CASE WHEN event_id % 50 = 0 THEN '%7Bbad' WHEN event_id % 50 = 3 THEN '%5B1%5D' ELSE url_encode(concat('{{',
   CASE WHEN event_id % 30 = 7 THEN '' ELSE concat('"event":"', CASE event_type WHEN 'signup' THEN 'game_start'
     WHEN 'error' THEN 'death' WHEN 'click' THEN 'key_press' ELSE event_type END, '",') END,
   '"player_name":"', CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('player_', cast(user_id as varchar(20))) END,
   '","level":"1-', regexp_extract(props, '[0-9]+', 0), '","large":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END,
   ',"lives":', cast(user_id % 4 as varchar(5)), '}}')) END) END,
   '&_t=', cast(event_id as varchar(20))) AS request_uri
FROM {events}
"""

#: Every third request as a POST with the payload as its body.
MIXED_REQUESTS = f"""
SELECT event_id, ts, user_header,
 CASE WHEN event_id % 3 = 0 THEN regexp_replace(request_uri, '[?].*', '') ELSE request_uri END AS request_uri,
 CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
 CASE WHEN event_id % 3 = 0 THEN url_decode(regexp_extract(request_uri, 'd=([^&]*)', 1)) END AS body
FROM ({REQUESTS}) r
"""

KEY_CODES = """
SELECT event_id, ts AS timestamp, cast(CASE user_id % 8 WHEN 0 THEN 37 WHEN 1 THEN 38 WHEN 2 THEN 39 WHEN 3 THEN 40
  WHEN 4 THEN 65 WHEN 5 THEN 83 WHEN 6 THEN 13 ELSE 32 END as int) AS key_code
FROM {events} WHERE event_type = 'click'
"""

SESSION_ENDS = """
SELECT event_id, ts AS timestamp, 'game.session_end' AS event_type,
 CASE WHEN event_id % 3 = 0 THEN value END AS duration,
 CASE WHEN event_id % 3 <> 2 THEN value * 10 END AS session_duration
FROM {events} WHERE event_type = 'purchase'
"""


def bind(statement: str, events: DataFrame) -> DataFrame:
    """Run a mapping over ``events``, which may be a stream."""
    return events.sparkSession.sql(statement, events=events)


class Telemetry:
    """Lazy frames over one data folder. Nothing is read until a result is asked for.

    The event table is derived from the given events, unless a stored one is passed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, event_table: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        # Timestamps without zone hold UTC, so formatting and truncation must not shift them.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._stored = event_table
        if event_table is not None:
            self.event_table = event_table

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    def events_stream(self) -> DataFrame:
        return (
            self.spark.readStream.schema(self.events.schema)
            .option("pathGlobFilter", "events.parquet")
            .parquet(self.sf_dir)
        )

    def bound(self, statement: str) -> DataFrame:
        return bind(statement, self.events)

    @cached_property
    def event_table(self) -> DataFrame:
        """Spans, metrics and logs of one service, and some spans and metrics of another, as stored records."""
        return records_of(self.events)

    def spread_event_table(self) -> DataFrame:
        """The rows of the event table, from events that are dealt over tasks first, whatever files they come in.

        Records are much more work than the events they come from, and a task reads no less than a row group.
        """
        if self._stored is not None:
            return self._stored
        return records_of(materialise(self.events.repartition(*self.events.columns), "events"))

    @cached_property
    def spans(self) -> DataFrame:
        return projections.spans(self.event_table)

    @cached_property
    def all_spans(self) -> DataFrame:
        """Game spans of every service."""
        return projections.spans(self.event_table, service=None)

    @cached_property
    def all_metrics(self) -> DataFrame:
        return projections.game_metrics(self.event_table, service=None)

    @cached_property
    def game_events(self) -> DataFrame:
        return projections.game_events(self.event_table)

    @cached_property
    def metrics(self) -> DataFrame:
        return projections.game_metrics(self.event_table)

    @cached_property
    def logs(self) -> DataFrame:
        return projections.game_logs(self.event_table)

    @cached_property
    def requests(self) -> DataFrame:
        return self.bound(REQUESTS)

    @cached_property
    def mixed_requests(self) -> DataFrame:
        """GET and POST requests."""
        return self.bound(MIXED_REQUESTS)


def records_of(events: DataFrame) -> DataFrame:
    """The event table of ``events``."""
    spans = bind(SPANS, events)
    other = spans.where(F.col("event_id") % 7 == 0)
    return (
        span_records(span_attributes(spans), DEFAULT_SERVICE)
        .unionByName(metric_records(bind(METRICS, events), DEFAULT_SERVICE))
        .unionByName(log_records(bind(LOGS, events), DEFAULT_SERVICE))
        .unionByName(span_records(span_attributes(other), OTHER_SERVICE))
        .unionByName(metric_records(bind(OTHER_METRICS, events), OTHER_SERVICE))
    )


def span_attributes(spans: DataFrame) -> DataFrame:
    """The flat columns packed into a map of text attributes, as a producer sends them."""
    names = {
        "player_name": "player_name",
        "level": "level",
        "coins": "coins",
        "lives": "lives",
        "key": "key_name",
        "type": "powerup_type",
        "session_duration": "session_duration",
        "session_id": "session_id",
    }
    pairs = [part for key, column in names.items() for part in (F.lit(key), F.col(column).cast("string"))]
    attributes = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    return spans.select("event_id", "timestamp", F.col("event_type").alias("name"), attributes.alias("attributes"))
