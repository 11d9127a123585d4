"""A stream over several files, in shuffled order, ends with the batch result."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import at, spans_frame
from playlens.operators import aggregates
from playlens.operators.throttle import key_throttle
from playlens.session import new_path
from playlens.sources.live_store import LIVE_TABLES
from playlens.streaming import live_tables
from playlens.streaming.live_tables import RUNNING_TABLES, closed_minutes, read_live, stream_live_tables, stream_table
from playlens.sources.stored import Manifest
from playlens.streaming.throttle import ThrottledKeys

ONCE = {"availableNow": True}
FILES = 4


@pytest.fixture(scope="module")
def source(spark):
    """(batch frame, function that opens a stream over its files)"""
    rng = random.Random(11)
    rows = []
    for number in range(400):
        event = rng.choice(["game_start", "death", "coin", "key_press", "level_start", "level_win", "powerup_spawn", "game_over"])
        rows.append(
            {
                "t": rng.randrange(600),
                "event": event,
                "player_name": rng.choice(["a", "b", None]),
                "level": rng.choice(["1-1", "2-1", None]),
                "key_name": rng.choice(["left", "up"]) if event == "key_press" else None,
                "powerup_type": "mushroom" if event == "powerup_spawn" else None,
                "session_id": rng.choice(["s1", "s2", None]),
            }
        )
    frame = spans_frame(spark, rows)
    folder = new_path(spark, "stream_source")
    for part in range(FILES):
        frame.where(F.col("event_id") % FILES == part).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return frame, stream


def same(left, right):
    columns = sorted(right.columns)
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(left) == text(right)


@pytest.mark.parametrize("name", ["event_timeline", "key_presses", "deaths_by_level", "powerups", "player_sessions"])
def test_stream_equals_batch(spark, source, name):
    frame, stream = source
    path, table = new_path(spark, name), RUNNING_TABLES[name]
    stream_table(stream(), table, path=path, checkpoint=new_path(spark, "cp"), trigger=ONCE).awaitTermination()
    assert Manifest.read(spark, path).batch == FILES - 1
    same(read_live(spark, path, table), LIVE_TABLES[name].build(frame))


def test_one_stream_feeds_all_tables(spark, source):
    frame, stream = source
    folder = new_path(spark, "all_live")
    stream_live_tables(stream(), folder=folder, checkpoint=new_path(spark, "cp"), trigger=ONCE).awaitTermination()
    same(live_tables.read_live_events(spark, folder), frame)
    for name, table in LIVE_TABLES.items():
        if name != "game_events":
            same(read_live(spark, f"{folder}/{name}", RUNNING_TABLES[name]), table.build(frame))


def test_closed_minutes_appear_once_and_complete(spark):
    rows = [{"t": 30 * i, "event": "death" if i % 3 else "key_press"} for i in range(120)]
    frame = spans_frame(spark, rows)
    folder, path = new_path(spark, "minutes_source"), new_path(spark, "minutes")
    for start in range(0, 120, 30):  # files in time order, one per batch
        frame.where(F.col("event_id").between(start + 1, start + 30)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live_tables.stream_game_events(
        closed_minutes(stream, watermark="10 minutes"), path=path, checkpoint=new_path(spark, "cp"), trigger=ONCE
    ).awaitTermination()
    got = spark.read.parquet(path).withColumn("minute", F.col("minute").cast("timestamp_ntz"))
    newest = 30 * 119
    closed = aggregates.event_timeline(frame).where(
        F.col("minute") + F.expr("interval 1 minute") <= F.lit(str(at(newest - 600))).cast("timestamp_ntz")
    )
    assert closed.count() > 0
    same(got, closed)


def key_rows(times, player="a", first_id=0):
    return [
        {"t": t, "event": "key_press", "player_name": player, "key_name": "left", "event_id": first_id + i}
        for i, t in enumerate(times)
    ]


def throttled(spark, batches, **options):
    """Ids kept of a stream that gets one list of rows after the other."""
    folder, schema = new_path(spark, "keys"), None
    for rows in batches:
        frame = spans_frame(spark, rows)
        schema = frame.schema
        frame.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = ThrottledKeys(new_path(spark, "kept"), **options)
    kept.stream(stream, checkpoint=new_path(spark, "cp"), trigger=ONCE).awaitTermination()
    return sorted(row["event_id"] for row in kept.read(spark).collect())


@pytest.mark.parametrize("gap_ms, slice_ms", [(500, 3_600_000), (500, 2000), (6 * 3_600_000, 24 * 3_600_000)])
def test_throttled_stream_equals_the_batch_operator(spark, gap_ms, slice_ms):
    rng = random.Random(5)
    scale = gap_ms / 500
    rows = [
        {
            "t": scale * rng.randrange(60000) / 1000,
            "event": "key_press",
            "player_name": rng.choices(["hot", "b", None], [6, 2, 1])[0],
            "key_name": rng.choice(["left", None]),
            "event_id": i,
        }
        for i in range(300)
    ]
    rows.sort(key=lambda row: row["t"])
    batches = [rows[start : start + 75] for start in range(0, 300, 75)]
    batch = key_throttle(spans_frame(spark, rows), gap_ms=gap_ms, slice_ms=slice_ms)
    assert throttled(spark, batches, gap_ms=gap_ms, slice_ms=slice_ms) == sorted(r["event_id"] for r in batch.collect())


def test_throttle_remembers_across_batches(spark):
    assert throttled(spark, [key_rows([0, 0.3], first_id=0), key_rows([0.5, 0.501], first_id=10), key_rows([0.9, 1.002], first_id=20)]) == [0, 11, 21]


def test_throttle_drops_events_older_than_the_last_kept(spark):
    late = [key_rows([10], first_id=0), key_rows([3, 10.4], first_id=10), key_rows([10.6], first_id=20), key_rows([9], "b", 30)]
    assert throttled(spark, late) == [0, 20, 30]


def test_throttle_runs_a_batch_again(spark):
    kept = ThrottledKeys(new_path(spark, "again"))
    first, second = spans_frame(spark, key_rows([0, 0.3])), spans_frame(spark, key_rows([0.4, 0.6], first_id=10))
    kept.write(first, 0)
    # The batch failed after its rows were committed and before its state was.
    kept._kept.append(key_throttle(second, kept_before=kept._last.read(spark)), 1)
    for _ in range(2):
        kept.write(second, 1)
    assert sorted(row["event_id"] for row in kept.read(spark).collect()) == [0, 11]
    kept.write(spans_frame(spark, key_rows([1.0, 1.2], first_id=20)), 2)
    assert sorted(row["event_id"] for row in kept.read(spark).collect()) == [0, 11, 21]


def test_hot_key_is_spread_over_tasks(spark):
    """One key holds every event; its slices go to several tasks, and no task sees them all."""
    frame = spans_frame(spark, key_rows([i / 2 for i in range(4000)]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = key_throttle(frame, gap_ms=100, slice_ms=60_000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(row["count"] for row in sizes) < 2000
