"""The stored layer: what is read, and that answers equal those from all events."""

from __future__ import annotations

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import ORIGIN, plan_of, spans_frame
from playlens.functions import predicates
from playlens.operators import aggregates, leaderboard, minutes, projections
from playlens.plans import feeds, rollups, verified
from playlens.plans.live_layer import LiveLayer
from playlens.session import new_path
from playlens.sources import live_store
from playlens.sources.bindings import span_attributes
from playlens.sources.day_table import DayTable, footer_counts
from playlens.sources.event_table import log_records, span_records, write_event_table
from playlens.streaming import live_tables

DAYS = 60


def events_of(seed, count, days=DAYS, first_id=1):
    rng = random.Random(seed)
    rows = []
    for number in range(count):
        event = rng.choice(["game_start", "death", "coin", "key_press", "game_over"])
        rows.append(
            {
                "t": rng.randrange(days * 86_400_000) / 1000,
                "event": event,
                "event_id": first_id + number,
                "player_name": rng.choices(["hot", None, "unknown", *"abcdefg"], [9, 1, 1, *[1] * 7])[0],
                "session_id": rng.choice([None, *[f"s{n}" for n in range(60)]]),
                "coins": rng.randrange(9),
                "session_duration": rng.choice([None, 1.5, 2.25]),
                "level": rng.choice(["1-1", "2-1"]),
                "key_name": "left" if event == "key_press" else None,
            }
        )
    return rows


@pytest.fixture(scope="module")
def records(spark):
    frame = spans_frame(spark, events_of(3, 3000))
    other = spans_frame(spark, events_of(4, 90, first_id=9000))
    logs = frame.where("event_id % 10 = 0").select("event_id", "timestamp", F.lit("INFO").alias("severity"), F.lit("x").alias("log_message"))
    return span_records(span_attributes(frame)).unionByName(span_records(span_attributes(other), "OTHER")).unionByName(log_records(logs))


@pytest.fixture(scope="module")
def layer(spark, records):
    built = LiveLayer(spark, new_path(spark, "layer"))
    built.append_records(records)
    built.refresh()
    return built


@pytest.fixture(scope="module")
def events(spark, records):
    frame = projections.game_events(records)
    rows = frame.collect()
    return spark.createDataFrame(rows, frame.schema)


def same(left, right):
    columns = sorted(right.columns)
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(left) == text(right)


def folders_read(frame):
    found = set()
    for row in frame.select(F.input_file_name().alias("f")).distinct().collect():
        found |= set(re.findall(r"event_date=([0-9-]+)", row.f))
    return found


def test_newest_first_reads_the_newest_days_only(layer, events):
    table, opened = layer.events, []

    def chosen(rows):
        opened.append(folders_read(rows))
        return rows

    same(table.newest(25, chosen), feeds.newest(events, 25))
    days = sorted(str(day) for day in table.days)
    assert len(days) == DAYS and opened == [set(days[-1:])]
    opened.clear()
    same(table.newest(140, chosen), feeds.newest(events, 140))
    assert [len(read) for read in opened] == [1, 2, 4] and opened[-1] == set(days[-4:])


def test_a_rare_player_is_found_in_the_end(layer, events):
    same(layer.event_feed(limit=500, player="a"), feeds.event_feed(events, limit=500, player="a"))
    assert layer.event_feed(limit=5, player="nobody").count() == 0


def test_lists_equal_those_over_all_events(layer, events):
    same(layer.event_feed(limit=300, as_text=True), feeds.event_feed(events, limit=300, as_text=True))
    same(layer.recent_sessions(), feeds.recent_sessions(events))
    for hours in (1, 24, 24 * 20):
        same(layer.leaderboard(hours=hours), leaderboard.leaderboard(events, hours=hours))
        same(layer.unique_players(hours=hours), aggregates.unique_players(events, hours=hours))
    same(layer.activity_summary(), verified.activity_summary(events))


def test_views_over_the_stored_records(layer, records, events):
    same(layer.view_newest(30), feeds.newest(events, 30))
    same(layer.latest_raw_span(), feeds.latest_raw_span(records))
    for minutes_ in (10, 2000):
        same(layer.recent_spans(minutes=minutes_), feeds.recent_spans(records, minutes=minutes_))
        same(layer.recent_logs(minutes=minutes_), feeds.recent_logs(records, minutes=minutes_))
        spans = predicates.last(projections.spans(records), minutes=minutes_, strict=True)
        same(layer.spans_of_last(minutes=minutes_, strict=True), spans)


def test_ranges_of_minutes_equal_brute_force(layer, events):
    rng = random.Random(6)
    rows = events.collect()
    tables = layer.by_minute()
    for _ in range(6):
        start = ORIGIN + timedelta(milliseconds=rng.randrange(DAYS * 86_400_000))
        end = start + timedelta(milliseconds=rng.choice([0, 30_000, 60_000, 3_600_000, 90_061_000, 10 * 86_400_000]))
        if rng.random() < 0.4:
            start, end = start.replace(second=0, microsecond=0), end.replace(second=0, microsecond=0)
        inside = [row for row in rows if start <= row.timestamp < end]
        got = tables.summary(start, end).first()
        sessions = {row.session_id for row in inside} - {None}
        assert tuple(got) == (len(inside), len(sessions), len({row.event_type for row in inside}))
        assert {row[0] for row in tables.distinct_ids("session_id", start, end).collect()} == sessions
        games = [row for row in inside if row.event_type == "game.game_over" and row.player_name not in (None, "unknown")]
        games.sort(key=lambda row: (-int(row.coins), row.duration is None, float(row.duration or 0), row.event_id))
        assert [row.event_id for row in tables.best_games(20, start, end).collect()] == [row.event_id for row in games[:20]]


def test_whole_minutes_read_no_events(layer):
    tables = minutes.MinuteTables(**{**layer.by_minute().__dict__, "events": None})
    start, end = ORIGIN + timedelta(days=3), ORIGIN + timedelta(days=9, minutes=7)
    assert tables.summary(start, end).first().total_events > 0
    assert tables.best_games(5, start, end).count() == 5


def test_ids_beyond_one_bitmap(spark):
    rows = spark.range(70_000).select(
        F.concat(F.lit("s"), F.col("id")).alias("session_id"),
        (F.lit(str(ORIGIN)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") / 10_000).cast("int"))).alias("timestamp"),
    )
    numbers = minutes.id_numbers(rows, "session_id")
    bitmaps = minutes.minute_ids(rows, numbers, "session_id")
    assert bitmaps.groupBy("minute").count().agg(F.max("count")).first()[0] <= 2  # numbers of one time are near one another
    tables = minutes.MinuteTables(None, lambda _: (numbers, bitmaps), None, None)
    start = ORIGIN + timedelta(minutes=2)
    assert tables.distinct_count("session_id", start, start + timedelta(minutes=3)).first()[0] == 30_000
    found = tables.distinct_ids("session_id", start, start + timedelta(minutes=3))
    assert found.count() == found.distinct().count() == 30_000 and found.where("session_id = 's20000'").count() == 1


def test_minutes_of_few_ids_have_small_bitmaps(spark):
    rows = spark.range(5000).select(
        F.concat(F.lit("s"), F.col("id") * 20).alias("session_id"),
        (F.lit(str(ORIGIN)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("timestamp"),
    )
    numbers = minutes.id_numbers(rows, "session_id")
    bitmaps = minutes.minute_ids(rows, numbers, "session_id")
    assert bitmaps.count() == 5000
    path = new_path(spark, "bitmaps")
    bitmaps.select(F.length(F.to_json("words")).alias("size")).write.parquet(path)
    assert spark.read.parquet(path).agg(F.max("size")).first()[0] < 200
    tables = minutes.MinuteTables(None, lambda _: (numbers, bitmaps), None, None)
    assert {r[0] for r in tables.distinct_ids("session_id", ORIGIN, ORIGIN + timedelta(minutes=130)).collect()} == {f"s{20 * i}" for i in range(130)}


def test_records_of_one_type_list_no_other_folders(layer):
    paths = layer.records("SPAN").rows().inputFiles()
    assert paths and all("/record_type=SPAN/" in path and f"/service={layer.service}/" in path for path in paths)
    counted = layer.records().count()
    assert counted == layer.records().rows().count()
    assert layer.records("NONE").count() == layer.records("NONE").rows().count() == 0


def test_counts_come_from_footers(spark, layer, records):
    counts = footer_counts(spark, f"{layer.folder}/records", ("service", "record_type", "event_date"), "record_type")
    assert "PushedAggregation: [COUNT(*)]" in counts._jdf.queryExecution().toString()
    same(counts, records.groupBy("record_type").agg(F.count("*").alias("total")))
    same(layer.record_type_counts(), aggregates.record_type_counts(records.where("event_id < 9000")))
    assert layer.records("SPAN").count() == 3000 and layer.records().count() == 3300


def test_health_and_profile_equal_those_over_all_events(layer, records, events):
    live = {name: table.build(events) for name, table in live_store.LIVE_TABLES.items()}
    same(layer.health_check(), rollups.health_check(records.where("event_id < 9000"), live))
    same(layer.profile(), rollups.live_table_profile(live))


def test_time_of_the_newest_row_reads_one_day(layer, events):
    assert layer.events.latest_time == events.agg(F.max("timestamp")).first()[0]
    assert layer.events.first_time == events.agg(F.min("timestamp")).first()[0]
    assert layer.events.last(hours=30).count() == events.where(
        F.col("timestamp") >= F.lit(str(layer.events.latest_time - timedelta(hours=30))).cast("timestamp_ntz")
    ).count()


def files_with(spark, path, condition, total):
    """Files whose statistics cannot rule the condition out: those that hold a matching row at least."""
    ranges = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min("timestamp").alias("from_t"), F.max("timestamp").alias("to_t"), F.min("player_name").alias("from_p"), F.max("player_name").alias("to_p")
    )
    assert ranges.count() == total
    return ranges.where(condition).count()


def test_any_cluster_column_skips_files(spark):
    """In one layout a filter on the time alone and one on the player alone both leave out most files."""
    rng = random.Random(2)
    rows = [{"t": rng.randrange(86_400), "event": rng.choice(["coin", "death"]), "player_name": f"p{rng.randrange(40):02d}"} for _ in range(6000)]
    table = spans_frame(spark, rows).select("event_id", "timestamp", "player_name", "event_type")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = {}
        for kind, layout in (("plain", live_store.cluster_layout), ("mixed", live_store.interleaved_layout)):
            paths[kind] = new_path(spark, kind)
            layout(table, ("player_name", "event_type", "timestamp")).write.parquet(paths[kind])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same(spark.read.parquet(paths["mixed"]), table)
    noon = f"from_t <= timestamp_ntz'{ORIGIN + timedelta(hours=13)}' AND to_t >= timestamp_ntz'{ORIGIN + timedelta(hours=12)}'"
    player = "from_p <= 'p20' AND to_p >= 'p20'"
    total = {kind: len(spark.read.parquet(path).inputFiles()) for kind, path in paths.items()}
    assert files_with(spark, paths["plain"], noon, total["plain"]) > 0.9 * total["plain"]
    assert files_with(spark, paths["mixed"], noon, total["mixed"]) < 0.5 * total["mixed"]
    assert files_with(spark, paths["mixed"], player, total["mixed"]) < 0.5 * total["mixed"]


def test_refresh_reads_new_files_only(spark, records, events):
    path, folder = new_path(spark, "records"), new_path(spark, "live")
    read = []
    for part, below in enumerate((2500, 2900, 99_999)):
        above = (0, 2500, 2900)[part]
        write_event_table(records.where((F.col("event_id") >= above) & (F.col("event_id") < below)), path, by_day=False)
        query = live_tables.refresh_new_files(spark, path, folder)
        read.append(sum(progress["numInputRows"] for progress in query.recentProgress))
        # The second call after the same files changes nothing.
        if part == 1:
            live_tables.refresh_new_files(spark, path, folder)
    assert read[1] <= 500 and read[2] <= 300 < read[0]
    same(live_tables.read_live_events(spark, folder).select(events.columns), events)
    for name in live_tables.NAMES:
        same(live_tables.read_live(spark, f"{folder}/{name}", live_tables.RUNNING_TABLES[name]), live_store.LIVE_TABLES[name].build(events))


def test_an_empty_layer(spark, records):
    layer = LiveLayer(spark, new_path(spark, "empty"))
    layer.append_records(records.where("record_type = 'LOG'"))
    layer.append_records(records.where("event_id >= 9000"))
    layer.refresh()
    assert layer.newest(5).count() == 0 and layer.event_feed().count() == 0 and layer.leaderboard().count() == 0
    assert layer.activity_summary().first().total_events == 0 and layer.unique_players().count() == 0
    assert layer.health_check().first().live_table_rows == 0
    assert DayTable(spark, f"{layer.folder}/records").count() == 390


def test_plans_of_stored_lists_have_no_wide_scan(layer):
    """A list is at most its rows; a range prunes the folders."""
    assert "LocalTableScan" in plan_of(layer.newest(3)) or "Scan ExistingRDD" in plan_of(layer.newest(3))
    plan = layer.events.last(hours=3)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*event_date", plan)
