"""Every query by name, bound to the given tables.

Each entry takes the telemetry of one data folder and returns a DataFrame. Entries that compare
times take the newest event as "now".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens import vocabulary as v
from playlens.functions import labels, predicates
from playlens.functions.attributes import json_text
from playlens.functions.timefns import boundary_diff, local_text, local_time, slice_minutes
from playlens.operators import aggregates, leaderboard, platform, projections, relationships, sessions
from playlens.operators.ordered import assign_interval
from playlens.operators.throttle import key_throttle
from playlens.plans import feeds, rollups, verified
from playlens.plans.live_layer import LiveLayer
from playlens.session import new_path
from playlens.sources import bindings, event_table, ingest, live_store
from playlens.sources.bindings import Telemetry, bind
from playlens.streaming import live_tables
from playlens.streaming.ingest import stream_ingest as stream_requests
from playlens.streaming.ingest import stream_quarantine as stream_rejected
from playlens.streaming.metrics import MetricExport
from playlens.streaming.throttle import ThrottledKeys

Query = Callable[[Telemetry], DataFrame]

QUERIES: dict[str, Query] = {}
PLAYER = "player_42"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def add(**entries: Query) -> None:
    QUERIES.update(entries)


#: The stored layers of this process, by application and data folder.
LAYERS: dict[tuple[str, str], LiveLayer] = {}


def layer(t: Telemetry) -> LiveLayer:
    """The stored layer over the given events. It is built when a query first asks for it, and dashboards read it from then on."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in LAYERS:
        built = LiveLayer(t.spark, new_path(t.spark, "layer"))
        built.append_records(t.spread_event_table())
        built.refresh()
        LAYERS[key] = built
    return LAYERS[key]


def live(t: Telemetry, name: str) -> DataFrame:
    """A live table as it is stored."""
    return layer(t).table(name)


def defined(t: Telemetry, name: str) -> DataFrame:
    """A live table as defined over the game events."""
    return live_store.LIVE_TABLES[name].build(t.game_events)


# --- scans and ingest -----------------------------------------------------------


@query
def scan_service_records(t: Telemetry) -> DataFrame:
    return event_table.scan_service_records(t.event_table).select("event_id", "timestamp", "record_type")


@query
def scan_event_table(t: Telemetry) -> DataFrame:
    """Store the event table, read the stored copy."""
    path = new_path(t.spark, "event_table")
    event_table.write_event_table(t.event_table, path)
    stored = event_table.read_event_table(t.spark, path)
    return event_table.scan_service_records(stored).select("event_id", "timestamp", "record_type")


@query
def split_by_record_type(t: Telemetry) -> DataFrame:
    parts = event_table.split_by_record_type(t.event_table)
    rows = None
    for kind, records in parts.items():
        part = records.select(F.lit(kind).alias("part"), "event_id", "timestamp")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query
def ingest_requests(t: Telemetry) -> DataFrame:
    good, _ = ingest.ingest_requests(t.requests)
    return good.select("event_id", "timestamp", "name", "player_name")


@query
def ingest_posts(t: Telemetry) -> DataFrame:
    """Events of GET and POST requests."""
    good, _ = ingest.ingest_requests(t.mixed_requests)
    attribute = lambda name: F.try_element_at("attributes", F.lit(name)).alias(name)
    return good.select("event_id", "timestamp", "name", "player_name", attribute("level"), attribute("lives"))


@query
def ingest_posts_malformed(t: Telemetry) -> DataFrame:
    _, quarantine = ingest.ingest_requests(t.mixed_requests)
    return quarantine.select("event_id", "request_uri", "payload")


@query
def ingest_drop_malformed(t: Telemetry) -> DataFrame:
    _, quarantine = ingest.ingest_requests(t.requests)
    return quarantine


@query
def ingest_no_payload(t: Telemetry) -> DataFrame:
    without = t.requests.where(F.size(ingest.encoded_payloads()) == 0)
    return without.select("event_id", "request_uri")


@query
def resolve_player(t: Telemetry) -> DataFrame:
    good, _ = ingest.ingest_requests(t.requests)
    return good.groupBy("player_name").agg(F.count("*").alias("requests"))


@query
def event_name(t: Telemetry) -> DataFrame:
    good, _ = ingest.ingest_requests(t.requests)
    return good.groupBy("name").agg(F.count("*").alias("requests"))


@query
def stringify_attributes(t: Telemetry) -> DataFrame:
    good, _ = ingest.ingest_requests(t.requests)
    return good.select("event_id", F.explode("attributes").alias("attribute", "value"))


@query
def route_known_events(t: Telemetry) -> DataFrame:
    good, _ = ingest.ingest_requests(t.requests)
    return ingest.route_known_events(good).select("event_id", "name", "known")


@query
def build_spans(t: Telemetry) -> DataFrame:
    return ingest.build_spans(t.requests).select(
        "event_id",
        "timestamp",
        "record_type",
        json_text("record").alias("record"),
        json_text("record_attributes").alias("record_attributes"),
        json_text("resource_attributes").alias("resource_attributes"),
    )


def _refreshed(name: str) -> Query:
    def run(t: Telemetry) -> DataFrame:
        folder = new_path(t.spark, "live")
        return live_store.refresh_live_tables(t.game_events, folder, (name,))[name]

    return run


add(**{f"refresh_{name}": _refreshed(name) for name in live_store.LIVE_TABLES})


@query
def refresh_live_tables(t: Telemetry) -> DataFrame:
    """Rebuild all six tables; rows of each."""
    tables = live_store.refresh_live_tables(t.game_events, new_path(t.spark, "live"))
    return rollups.live_table_profile(tables).select("table_name", "total_rows")


@query
def refresh_new_files(t: Telemetry) -> DataFrame:
    """The event table in two parts, and a refresh after each that reads only the new one; rows of each table."""
    records, folder = new_path(t.spark, "records"), new_path(t.spark, "live")
    for part in (0, 1):
        event_table.write_event_table(t.event_table.where(F.col("event_id") % 2 == part), records, by_day=False)
        live_tables.refresh_new_files(t.spark, records, folder)
    return _streamed_profile(t, folder)


@query
def scan_live_table(t: Telemetry) -> DataFrame:
    folder = new_path(t.spark, "live")
    table = live_store.LIVE_TABLES["deaths_by_level"]
    live_store.write_live_table(table.build(t.game_events), f"{folder}/deaths_by_level", table.cluster_by)
    return live_store.scan_live_table(t.spark, folder, "deaths_by_level")


@query
def cluster_layout(t: Telemetry) -> DataFrame:
    return live_store.cluster_layout(defined(t, "key_presses"), live_store.LIVE_TABLES["key_presses"].cluster_by)


# --- projections and predicates -------------------------------------------------

add(
    game_events=lambda t: t.game_events,
    game_logs=lambda t: t.logs.select("timestamp", "log_message", "severity"),
    game_metrics=lambda t: t.metrics.select(
        "timestamp", "metric_name", "metric_value", "scope", json_text("record_attributes").alias("record_attributes")
    ),
    game_traces=lambda t: projections.game_traces(t.event_table)
    .withColumn("record_attributes", json_text("record_attributes"))
    .drop("event_id"),
    spans=lambda t: t.spans,
    recent_spans=lambda t: layer(t).recent_spans(),
    recent_spans_6h=lambda t: layer(t).recent_spans(minutes=360),
    recent_logs=lambda t: layer(t).recent_logs(),
    recent_logs_6h=lambda t: layer(t).recent_logs(minutes=360),
    latest_raw_span=lambda t: layer(t).latest_raw_span(),
    latest_view_event=lambda t: layer(t).view_newest(1),
    latest_live_event=lambda t: layer(t).newest(1),
    pred_prefix=lambda t: t.spans.where(predicates.has_prefix("game.game_")).select("event_id", "event_type"),
    pred_exclude=lambda t: t.spans.where(predicates.not_event("key_press")).select("event_id", "event_type"),
    pred_metric_in=lambda t: t.metrics.where(F.col("metric_name").isin(v.CONNECTIONS, v.CONNECTION_RATE)).select(
        "event_id", "metric_name", "metric_value"
    ),
    pred_between=lambda t: predicates.in_range(
        t.metrics, start="2024-01-05 00:00:00", end="2024-01-20 12:00:00"
    ).select("event_id", "metric_name", "timestamp"),
    pred_all_time=lambda t: predicates.in_range(t.metrics, start="2020-01-01 00:00:00").select("event_id"),
    time_range_presets=lambda t: rollups.events_per_range(t.spans),
    pred_known_player=lambda t: t.spans.where(predicates.known_player()).select("event_id", "player_name"),
    pred_player=lambda t: predicates.of_player(t.spans, PLAYER).select("event_id", "player_name"),
    pred_session_present=lambda t: t.spans.where(F.col("session_id").isNotNull()).select("event_id", "session_id"),
    pred_ilike=lambda t: t.logs.where(
        predicates.contains_text("log_message", "ERROR") | predicates.contains_text("log_message", "WARN")
    ).select("event_id", "log_message"),
    key_lookup=lambda t: t.bound(bindings.KEY_CODES)
    .withColumn("key_name", labels.key_name("key_code"))
    .where(F.col("key_name").isNotNull()),
)


def _last(strict: bool = False, **window) -> Query:
    return lambda t: layer(t).spans_of_last(strict=strict, **window).select("event_id", "timestamp")


add(
    pred_last_24h=_last(hours=24),
    pred_last_6h=_last(hours=6),
    pred_last_1h=_last(hours=1, strict=True),
    pred_last_30m=_last(minutes=30),
    pred_last_10m=_last(minutes=10, strict=True),
    pred_last_5m=_last(minutes=5, strict=True),
)

# --- sessions, order, relationships ---------------------------------------------

add(
    session_match=lambda t: sessions.session_match(t.spans, sessions.session_core(t.spans)),
    session_deaths=lambda t: sessions.session_deaths(sessions.session_core(t.spans)),
    session_levels=lambda t: sessions.session_levels(sessions.session_core(t.spans)),
    session_enrich=lambda t: _enriched(t),
    game_sessions=lambda t: sessions.game_sessions(t.spans),
    game_sessions_by_player=lambda t: sessions.game_sessions(t.spans, partition_by_player=True),
    game_sessions_as_of=lambda t: sessions.game_sessions(t.spans, as_of="2024-01-15 12:00:00"),
    game_sessions_15=lambda t: sessions.game_sessions(t.spans).orderBy(F.desc("session_start"), F.desc("session_id")).limit(15),
    avg_stats=lambda t: sessions.avg_stats(sessions.game_sessions(t.spans), aggregates.player_stats(t.spans)),
    avg_stats_cross=lambda t: sessions.avg_stats_cross(
        sessions.game_sessions(t.spans), aggregates.player_stats(t.spans).select("player_name", "total_games", "total_deaths")
    ),
    avg_stats_single=lambda t: sessions.avg_stats(
        sessions.game_sessions(t.spans), aggregates.player_stats(t.spans), single_row=True
    ),
    session_ids=lambda t: sessions.session_ids(t.spans),
    session_next_start=lambda t: sessions.session_next_start(sessions.game_starts(t.spans)),
    session_first_over=lambda t: sessions.session_core(t.spans)
    .where(F.col("session_end").isNotNull())
    .select("session_id", "session_end", "final_level", "final_coins"),
    top_scores=lambda t: leaderboard.top_scores(t.spans),
    top_scores_all=lambda t: leaderboard.top_scores(t.spans, hours=None),
    top_scores_20=lambda t: leaderboard.top_scores(t.spans).orderBy("rank").limit(20),
    leaderboard=lambda t: layer(t).leaderboard(),
    leaderboard_text=lambda t: layer(t).leaderboard(as_text=True),
    leaderboard_view=lambda t: leaderboard.leaderboard(t.game_events),
    rel_events_keys=lambda t: relationships.join_relationship(
        t.game_events.select("event_id", "event_type", "player_name", "key_name"),
        live(t, "key_presses"),
        ["player_name", "key_name"],
    ),
    rel_powerups_deaths=lambda t: relationships.join_relationship(
        live(t, "powerups"), live(t, "deaths_by_level"), ["player_name", "level"]
    ),
    check_cardinality=lambda t: _cardinalities(t),
    check_primary_key=lambda t: relationships.check_primary_key(live(t, "key_presses"), ["player_name", "key_name"]),
    check_primary_key_levels=lambda t: relationships.check_primary_key(
        live(t, "deaths_by_level"), ["player_name", "level"]
    ),
)


def _enriched(t: Telemetry) -> DataFrame:
    """The report joined from the matched sessions, their deaths and their levels."""
    core = sessions.session_core(t.spans)
    return sessions.session_enrich(sessions.session_match(t.spans, core), sessions.session_deaths(core), sessions.session_levels(core))


def _cardinalities(t: Telemetry) -> DataFrame:
    checks = (
        ("game_events", "key_presses", ["player_name", "key_name"]),
        ("powerups", "deaths_by_level", ["player_name", "level"]),
        ("game_events", "player_sessions", ["player_name"]),
    )
    rows = None
    for left, right, on in checks:
        row = relationships.check_cardinality(live(t, left), live(t, right), on).select(
            F.lit(left).alias("left_table"), F.lit(right).alias("right_table"), "*"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def interval_assignment(t: Telemetry) -> DataFrame:
    """Deaths with the ended session they fall in."""
    ended = sessions.session_core(t.spans).where(F.col("session_end").isNotNull())
    deaths = t.spans.where(predicates.is_event("death")).select("event_id", "timestamp", "level")
    return assign_interval(
        deaths,
        ended.select("session_id", "session_start", "session_end"),
        point="timestamp",
        start="session_start",
        end="session_end",
        point_id="event_id",
        carry=["session_id"],
    )


# --- aggregates -----------------------------------------------------------------

add(
    player_stats=lambda t: aggregates.player_stats(t.spans),
    event_timeline=lambda t: aggregates.event_timeline(t.spans),
    key_presses=lambda t: aggregates.key_presses(t.spans),
    deaths_by_level=lambda t: aggregates.deaths_by_level(t.spans),
    powerups=lambda t: aggregates.powerups(t.spans),
    player_sessions=lambda t: aggregates.player_sessions(t.spans),
    record_type_counts=lambda t: layer(t).record_type_counts(),
    record_type_counts_view=lambda t: aggregates.record_type_counts(event_table.scan_service_records(t.event_table)),
    metric_inventory=lambda t: aggregates.metric_inventory(t.metrics),
    cpu_usage=lambda t: platform.cpu_usage(t.metrics, minutes=360),
    cpu_usage_all=lambda t: platform.cpu_usage(t.metrics, zone=v.DEFAULT_ZONE),
    cpu_usage_local_group=lambda t: platform.cpu_usage(t.metrics, zone=v.DEFAULT_ZONE, local_group=True),
    cpu_usage_30m=lambda t: platform.cpu_usage(t.all_metrics, minutes=30, strict=True),
    cpu_usage_between=lambda t: platform.cpu_usage(t.metrics, start="2024-01-05 00:00:00", end="2024-01-20 12:00:00"),
    memory_usage=lambda t: platform.memory_usage(t.metrics, minutes=360),
    memory_usage_30m=lambda t: platform.memory_usage(t.all_metrics, minutes=30, strict=True),
    memory_usage_all=lambda t: platform.memory_usage(t.metrics, zone=v.DEFAULT_ZONE),
    network_ingress=lambda t: platform.network_ingress(t.metrics, minutes=360),
    network_ingress_all=lambda t: platform.network_ingress(t.metrics, zone=v.DEFAULT_ZONE),
    network_connections=lambda t: platform.network_connections(t.all_metrics, minutes=30, strict=True),
    network_connections_all=lambda t: platform.network_connections(t.metrics),
    collector_throughput=lambda t: platform.collector_throughput(t.metrics, minutes=360),
    collector_throughput_all=lambda t: platform.collector_throughput(t.metrics, zone=v.DEFAULT_ZONE),
    log_health=lambda t: platform.log_health(t.logs, minutes=360),
    log_health_all=lambda t: platform.log_health(t.logs),
    log_health_minute=lambda t: platform.log_health(t.logs, bucket=1, name="minute", zone=v.DEFAULT_ZONE),
    event_distribution_1h=lambda t: aggregates.event_distribution(t.all_spans),
    event_distribution_24h=lambda t: aggregates.event_distribution(t.all_spans, hours=24),
    unique_players_1h=lambda t: aggregates.unique_players(t.all_spans),
    distinct_players=lambda t: aggregates.unique_players(t.all_spans, hours=None),
    unique_players_live_1h=lambda t: layer(t).unique_players(),
    unique_players_live_24h=lambda t: layer(t).unique_players(hours=24),
    players_list=lambda t: aggregates.players_list(live(t, "game_events")),
    kpi_totals=lambda t: rollups.kpi_totals(live(t, "game_events"), live(t, "powerups")),
    kpi_totals_player=lambda t: rollups.kpi_totals(live(t, "game_events"), live(t, "powerups"), player=PLAYER),
    health_check=lambda t: layer(t).health_check(),
    deaths_rollup=lambda t: rollups.deaths_rollup(live(t, "deaths_by_level")),
    deaths_rollup_player=lambda t: rollups.deaths_rollup(live(t, "deaths_by_level"), player=PLAYER),
    keys_rollup=lambda t: rollups.keys_rollup(live(t, "key_presses")),
    keys_rollup_player=lambda t: rollups.keys_rollup(live(t, "key_presses"), player=PLAYER),
    powerups_rollup=lambda t: rollups.powerups_rollup(live(t, "powerups")),
    powerups_rollup_player=lambda t: rollups.powerups_rollup(live(t, "powerups"), player=PLAYER),
    recent_event_distribution=lambda t: rollups.recent_event_distribution(layer(t).event_feed(limit=200)),
    timeline_pivot=lambda t: rollups.timeline_pivot(live(t, "event_timeline"), event_types=_labels()),
    timeline_pivot_last30=lambda t: rollups.timeline_pivot_recent(live(t, "event_timeline"), event_types=_labels()),
    event_types=lambda t: rollups.event_types(live(t, "event_timeline")),
    counter_events=lambda t: aggregates.counter_events(t.spans),
    counter_death_level=lambda t: aggregates.labelled_counter(t.spans, "death", "level"),
    counter_win_level=lambda t: aggregates.labelled_counter(t.spans, "level_win", "level"),
    counter_level_start=lambda t: aggregates.labelled_counter(
        projections.attribute_frame(t.event_table), "level_start", "level", "difficulty"
    ),
    counter_key=lambda t: aggregates.labelled_counter(t.spans, "key_press", "key_name"),
    counter_powerup=lambda t: aggregates.labelled_counter(t.spans, "powerup_spawn", "powerup_type"),
    counters=lambda t: aggregates.counters(projections.attribute_frame(t.event_table)),
    session_duration_histogram=lambda t: _rounded_sum(
        aggregates.session_duration_histogram(t.bound(bindings.SESSION_ENDS))
    ),
)


def _labels() -> list[str]:
    """The labels of the events that the given tables hold, which a pivot would else look for in a job of its own."""
    return [labels.label_of(name) for name in ("coin", "death", "game_over", "game_start", "level_start", "level_win", "powerup_spawn")]


def _rounded_sum(histogram: DataFrame) -> DataFrame:
    """Sums of doubles differ in the last digits with the order of addition."""
    return histogram.withColumn("sum_duration", F.round("sum_duration", 2))


# --- lists ----------------------------------------------------------------------

add(
    live_events_25=lambda t: layer(t).newest(25),
    live_events_10=lambda t: layer(t).newest(10),
    view_events_10=lambda t: layer(t).view_newest(10),
    event_feed_500=lambda t: layer(t).event_feed(limit=500),
    event_feed_200=lambda t: layer(t).event_feed(limit=200, as_text=True),
    event_feed_player=lambda t: layer(t).event_feed(limit=200, player=PLAYER, as_text=True),
    event_feed_view=lambda t: feeds.event_feed(t.game_events, limit=500),
    timeline_20=lambda t: feeds.timeline(live(t, "event_timeline"), limit=20),
    timeline_10=lambda t: feeds.timeline(live(t, "event_timeline"), limit=10),
    timeline_500=lambda t: feeds.timeline(live(t, "event_timeline"), limit=500, zone=v.DEFAULT_ZONE, as_text=True),
    timeline_all=lambda t: feeds.timeline(live(t, "event_timeline"), zone=v.DEFAULT_ZONE),
    recent_sessions_50=lambda t: layer(t).recent_sessions(),
    recent_sessions_player=lambda t: layer(t).recent_sessions(player=PLAYER),
    recent_sessions_view=lambda t: feeds.recent_sessions(t.game_events),
    player_sessions_desc=lambda t: feeds.largest(live(t, "player_sessions"), "session_start"),
    player_stats_by_coins=lambda t: feeds.largest(aggregates.player_stats(t.spans), "total_coins_collected"),
    deaths_desc=lambda t: feeds.largest(live(t, "deaths_by_level"), "deaths"),
    keys_desc=lambda t: feeds.largest(live(t, "key_presses"), "presses"),
    powerups_desc=lambda t: feeds.largest(live(t, "powerups"), "count"),
    sample_metrics=lambda t: feeds.sample(t.metrics).select("timestamp", "metric_name", "metric_value", "scope"),
    sample_logs=lambda t: feeds.sample(t.logs).select("timestamp", "log_message", "severity"),
    sample_traces=lambda t: feeds.sample(projections.game_traces(t.event_table)).select(
        "timestamp", "span_name", "player_name", "trace_id", "span_id"
    ),
    live_table_profile=lambda t: layer(t).profile(),
)

# --- scalar functions -----------------------------------------------------------

add(
    fn_event_label=lambda t: t.spans.select("event_id", labels.event_label().alias("label")),
    fn_local_time=lambda t: t.spans.select(
        "event_id", local_time("timestamp").alias("local"), local_text("timestamp").alias("local_text")
    ),
    fn_time_slice=lambda t: t.spans.select("event_id", slice_minutes("timestamp", 5).alias("period")),
    fn_boundary_diff=lambda t: live(t, "player_sessions").select(
        "player_name",
        "session_id",
        *[
            boundary_diff(unit, "session_start", "session_end").alias(f"{unit.lower()}s")
            for unit in ("SECOND", "MINUTE", "HOUR")
        ],
    ),
)

# --- verified questions ---------------------------------------------------------

add(
    vq_event_frequency=lambda t: verified.event_frequency(live(t, "game_events")),
    vq_deaths_per_level=lambda t: verified.deaths_per_level(live(t, "deaths_by_level")),
    vq_key_frequency=lambda t: verified.key_frequency(live(t, "key_presses")),
    vq_powerup_totals=lambda t: verified.powerup_totals(live(t, "powerups")),
    vq_sessions_by_coins=lambda t: verified.sessions_by_coins(live(t, "player_sessions")),
    vq_events_per_hour=lambda t: verified.events_per_hour(live(t, "game_events")),
    vq_recent_timeline=lambda t: verified.recent_timeline(live(t, "event_timeline")),
    vq_powerups_by_level=lambda t: verified.powerups_by_level(live(t, "powerups")),
    vq_activity_summary=lambda t: layer(t).activity_summary(),
    vq_activity_summary_24h=lambda t: layer(t).activity_summary(hours=24),
    vq_activity_summary_view=lambda t: verified.activity_summary(t.game_events),
    vq_session_outcomes=lambda t: verified.session_outcomes(live(t, "player_sessions")),
    vq_session_minutes=lambda t: verified.session_minutes(live(t, "player_sessions")),
    vq_player_sessions=lambda t: verified.sessions_per_player(live(t, "player_sessions")),
    vq_player_deaths=lambda t: verified.player_deaths(live(t, "deaths_by_level")),
)

# --- streams --------------------------------------------------------------------

ONCE = {"availableNow": True}


def _flat_stream(t: Telemetry) -> DataFrame:
    """The game events as a stream over the files of the given table."""
    spans = bind(bindings.SPANS, t.events_stream())
    records = event_table.span_records(bindings.span_attributes(spans))
    return projections.game_events(records)


def _streamed(name: str) -> Query:
    def run(t: Telemetry) -> DataFrame:
        table = live_tables.RUNNING_TABLES[name]
        path, checkpoint = new_path(t.spark, name), new_path(t.spark, "checkpoint")
        live_tables.stream_table(
            _flat_stream(t), table, path=path, checkpoint=checkpoint, trigger=ONCE
        ).awaitTermination()
        return live_tables.read_live(t.spark, path, table)

    return run


add(
    stream_event_timeline=_streamed("event_timeline"),
    stream_key_presses=_streamed("key_presses"),
    stream_deaths=_streamed("deaths_by_level"),
    stream_powerups=_streamed("powerups"),
    stream_player_sessions=_streamed("player_sessions"),
)


@query
def stream_counters(t: Telemetry) -> DataFrame:
    table = live_tables.RUNNING_TABLES["counters"]
    path, checkpoint = new_path(t.spark, "counters"), new_path(t.spark, "checkpoint")
    spans = bind(bindings.SPANS, t.events_stream())
    source = projections.attribute_frame(event_table.span_records(bindings.span_attributes(spans)))
    live_tables.stream_table(source, table, path=path, checkpoint=checkpoint, trigger=ONCE).awaitTermination()
    return live_tables.read_live(t.spark, path, table)


@query
def stream_session_duration(t: Telemetry) -> DataFrame:
    table = live_tables.RUNNING_TABLES["session_duration"]
    path, checkpoint = new_path(t.spark, "durations"), new_path(t.spark, "checkpoint")
    source = bind(bindings.SESSION_ENDS, t.events_stream())
    live_tables.stream_table(source, table, path=path, checkpoint=checkpoint, trigger=ONCE).awaitTermination()
    return _rounded_sum(live_tables.read_live(t.spark, path, table))


@query
def stream_game_events(t: Telemetry) -> DataFrame:
    path = new_path(t.spark, "game_events")
    live_tables.stream_game_events(
        _flat_stream(t), path=path, checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE
    ).awaitTermination()
    return t.spark.read.parquet(path)


@query
def stream_live_tables(t: Telemetry) -> DataFrame:
    """All live tables from one stream; rows of each."""
    folder = new_path(t.spark, "live")
    live_tables.stream_live_tables(
        _flat_stream(t), folder=folder, checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE
    ).awaitTermination()
    return _streamed_profile(t, folder)


def _streamed_profile(t: Telemetry, folder: str) -> DataFrame:
    """Rows of each streamed live table."""
    tables = {"game_events": live_tables.read_live_events(t.spark, folder)}
    for name in live_tables.NAMES:
        tables[name] = live_tables.read_live(t.spark, f"{folder}/{name}", live_tables.RUNNING_TABLES[name])
    return rollups.live_table_profile(tables).select("table_name", "total_rows")


@query
def stream_closed_minutes(t: Telemetry) -> DataFrame:
    """Minutes the watermark has passed."""
    path = new_path(t.spark, "minutes")
    live_tables.stream_game_events(
        live_tables.closed_minutes(_flat_stream(t)),
        path=path,
        checkpoint=new_path(t.spark, "checkpoint"),
        trigger=ONCE,
    ).awaitTermination()
    return t.spark.read.parquet(path).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def _ingested(statement: str) -> Query:
    def run(t: Telemetry) -> DataFrame:
        path = new_path(t.spark, "event_table")
        requests = bind(statement, t.events_stream())
        stream_requests(
            requests, path=path, checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE
        ).awaitTermination()
        return projections.game_events(event_table.read_event_table(t.spark, path)).select(
            "event_id", "timestamp", "event_type", "player_name", "level", "lives"
        )

    return run


add(stream_ingest=_ingested(bindings.REQUESTS), stream_ingest_posts=_ingested(bindings.MIXED_REQUESTS))


@query
def stream_quarantine(t: Telemetry) -> DataFrame:
    path = new_path(t.spark, "quarantine")
    requests = bind(bindings.REQUESTS, t.events_stream())
    stream_rejected(requests, path=path, checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "request_uri", "payload")


add(
    freshness=lambda t: layer(t).freshness(),
    freshness_view=lambda t: rollups.freshness(t.game_events, as_of=predicates.now_of(t.event_table)),
    key_throttle=lambda t: key_throttle(t.spans),
    key_throttle_6h=lambda t: key_throttle(t.spans, gap_ms=6 * 3_600_000, slice_ms=24 * 3_600_000),
)


def _throttled(**options) -> Query:
    def run(t: Telemetry) -> DataFrame:
        kept = ThrottledKeys(new_path(t.spark, "kept_keys"), **options)
        kept.stream(_flat_stream(t), checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE).awaitTermination()
        return kept.read(t.spark)

    return run


add(
    stream_key_throttle=_throttled(),
    stream_key_throttle_6h=_throttled(gap_ms=6 * 3_600_000, slice_ms=24 * 3_600_000),
)


@query
def stream_metrics(t: Telemetry) -> DataFrame:
    """The collector's instruments exported from a stream of requests, read back as metrics."""
    export = MetricExport(new_path(t.spark, "metrics"))
    requests = bind(bindings.REQUESTS, t.events_stream())
    export.stream_requests(requests, checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE).awaitTermination()
    return projections.game_metrics(export.read(t.spark)).select(
        "timestamp", "metric_name", "metric_value", "scope", json_text("record_attributes").alias("record_attributes")
    )


@query
def stream_metric_histogram(t: Telemetry) -> DataFrame:
    """The histogram of session durations exported from a stream, point by point."""
    export = MetricExport(new_path(t.spark, "metrics"))
    ends = bind(bindings.SESSION_ENDS, t.events_stream())
    none = {name: F.lit(None).cast("string") for name in ("level", "difficulty", "key_name", "powerup_type")}
    export.stream(ends.withColumns(none), checkpoint=new_path(t.spark, "checkpoint"), trigger=ONCE).awaitTermination()
    points = projections.histogram_points(export.read(t.spark)).withColumn("bucket_counts", F.to_json("bucket_counts"))
    return points.withColumn("sum_value", F.round("sum_value", 4)).drop("event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(run: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(Telemetry(spark, sf_dir))

    return {name: bound(run) for name, run in QUERIES.items()}
