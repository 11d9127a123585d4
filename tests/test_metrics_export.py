"""Instruments exported as METRIC records."""

from __future__ import annotations

import random
from datetime import timedelta
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from helpers import ORIGIN
from playlens.functions.attributes import json_text
from playlens.operators import aggregates, projections
from playlens.session import new_path
from playlens.sources.ingest import build_spans, request_attributes
from playlens.streaming.metrics import MetricExport

ONCE = {"availableNow": True}
SCHEMA = "event_id bigint, ts timestamp_ntz, user_header string, request_uri string"
EVENTS = ["game_start", "death", "level_win", "game_win", "game_over", "key_press", "level_start", "coin", "powerup_spawn", "session_end", "other"]


def requests(seed, count, first_id, start):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        event = rng.choices(EVENTS, [1, 1, 1, 1, 1, 9, 1, 1, 1, 3, 1])[0]
        attributes = {"key": rng.choice(["left", "up"]), "level": rng.choice(["1-1", "2-1"]), "difficulty": "hard", "type": "mushroom"}
        if event == "session_end":
            attributes = {rng.choice(["duration", "session_duration"]): str(rng.choice([0, 5, 5.5, 700, 20000]))}
        sent = {key: value for key, value in attributes.items() if rng.random() < 0.8}
        text = ",".join(f'"{key}":"{value}"' for key, value in {"event": event, **sent}.items())
        at = ORIGIN + timedelta(seconds=start + rng.randrange(40))
        rows.append((first_id + i, at, "", f"/telemetry?d={quote('{' + text + '}')}&_t=1"))
    return rows


def exported(spark, batches, restart_after=None):
    folder, checkpoint = new_path(spark, "requests"), new_path(spark, "cp")
    export = MetricExport(new_path(spark, "metrics"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        export.stream_requests(stream, checkpoint=checkpoint, trigger=ONCE).awaitTermination()

    for number, rows in enumerate(batches, start=1):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if number == restart_after:
            run()
    run()
    return export, spark.read.parquet(folder)


def totals(metrics):
    rows = metrics.where("metric_value IS NOT NULL").select("metric_name", json_text("record_attributes").alias("labels"), "metric_value")
    return {(row[0], row[1]): row[2] for row in rows.groupBy("metric_name", "labels").agg(F.max("metric_value")).collect()}


def counted(attributes):
    sent = {"key_name": "key", "powerup_type": "type"}
    labels = {name: [sent.get(label, label) for label in pair if label] for name, *pair in aggregates.INSTRUMENTS.values()}
    found = {}
    for row in aggregates.counters(attributes).collect():
        pairs = sorted(zip(labels[row.instrument], (row.label_1, row.label_2)))
        found["game." + row.instrument, "{" + ",".join(f'"{key}":"{value}"' for key, value in pairs) + "}"] = row.total
    return found


@pytest.mark.parametrize("restart_after", [None, 1, 2])
def test_totals_equal_the_counters(spark, restart_after):
    # The last batch comes late: its events are as old as the first one's.
    batches = [requests(1, 150, 0, 0), requests(2, 150, 1000, 40), requests(3, 60, 2000, 3)]
    export, given = exported(spark, batches, restart_after)
    attributes = request_attributes(given)
    points = export.read(spark)
    # The points are records of the event table, beside the spans.
    table = build_spans(given).unionByName(points)
    metrics = projections.game_metrics(table)
    assert totals(metrics) == counted(attributes)
    assert projections.game_events(table).count() == len(given.collect())
    inventory = {row.metric_name for row in aggregates.metric_inventory(metrics).collect()}
    assert "game.key.press" in inventory and "game.session.duration" in inventory

    histogram = projections.histogram_points(table).orderBy(F.desc("timestamp"), F.desc("total")).first()
    buckets = {row.bucket: row for row in aggregates.session_duration_histogram(attributes).collect()}
    assert histogram.bucket_counts == [buckets[i].total if i in buckets else 0 for i in range(16)]
    assert histogram.total == sum(row.total for row in buckets.values())
    assert histogram.sum_value == pytest.approx(sum(row.sum_duration for row in buckets.values()))
    assert (histogram.min_value, histogram.max_value) == (0.0, 20000.0)


def test_points_are_cumulative_and_never_fall(spark):
    export, given = exported(spark, [requests(4, 200, 0, 0), requests(5, 200, 1000, 20)])
    metrics = projections.game_metrics(export.read(spark)).where("metric_value IS NOT NULL")
    rows = metrics.select("metric_name", json_text("record_attributes").alias("labels"), "timestamp", "metric_value").collect()
    series = {}
    for row in sorted(rows, key=lambda row: (row.timestamp, row.metric_value)):
        assert row.timestamp.second % 5 == 0
        assert row.metric_value >= series.get(row[:2], 0)
        series[row[:2]] = row.metric_value
    first = min(row.timestamp for row in rows)
    events = request_attributes(given).where(F.col("timestamp") < F.lit(first).cast("timestamp_ntz"))
    assert {(row[0], row[1]): row[3] for row in rows if row.timestamp == first} == counted(events)


def test_a_batch_that_runs_again_counts_once(spark):
    export = MetricExport(new_path(spark, "again"))
    frames = [request_attributes(spark.createDataFrame(requests(seed, 80, 100 * seed, 9 * seed), SCHEMA)) for seed in (1, 2)]
    export.write(frames[0], 0)
    held = export._totals.read_for(export._partial(frames[1]))
    export._points.append(export._records(export._cumulative(export._partial(frames[1]), held)), 1)  # failed before the totals
    for _ in range(2):
        export.write(frames[1], 1)
    assert totals(projections.game_metrics(export.read(spark))) == counted(frames[0].unionByName(frames[1]))


def test_a_batch_without_events(spark):
    export = MetricExport(new_path(spark, "none"))
    empty = request_attributes(spark.createDataFrame([], SCHEMA))
    export.write(empty, 0)
    assert export.read(spark).count() == 0
    some = request_attributes(spark.createDataFrame(requests(1, 30, 0, 0), SCHEMA))
    export.write(some, 1)
    export.write(empty, 2)
    assert totals(projections.game_metrics(export.read(spark))) == counted(some)
