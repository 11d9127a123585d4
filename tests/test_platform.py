from __future__ import annotations

from datetime import datetime

from playlens.functions.timefns import boundary_diff
from playlens.operators import platform
from playlens.vocabulary import CPU
from pyspark.sql import functions as F


def metrics(spark, *times):
    data = [(i, t, CPU, 0.5) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "event_id bigint, timestamp timestamp_ntz, metric_name string, metric_value double")


def test_repeated_hour_stays_apart_unless_grouped_locally(spark):
    rows = metrics(spark, datetime(2024, 10, 27, 0, 30), datetime(2024, 10, 27, 1, 30))
    apart = platform.cpu_usage(rows, zone="Europe/Stockholm").collect()
    merged = platform.cpu_usage(rows, zone="Europe/Stockholm", local_group=True).collect()
    assert [row["minute"] for row in apart] == ["2024-10-27T02:30:00"] * 2
    assert [row["minute"] for row in merged] == ["2024-10-27T02:30:00"]


def test_now_is_that_of_all_metrics(spark):
    rows = metrics(spark, datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 1, 0, 10))
    later = rows.limit(1).withColumn("metric_name", F.lit("other")).withColumn(
        "timestamp", F.lit("2024-01-01 00:35:00").cast("timestamp_ntz")
    )
    assert platform.cpu_usage(rows.unionByName(later), minutes=30).count() == 1
    assert platform.cpu_usage(rows, minutes=30, as_of="2024-01-01 00:30:00").count() == 2


def test_boundaries_are_counted_not_durations(spark):
    row = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00.9' AS a, TIMESTAMP_NTZ '2024-01-01 00:00:01.1' AS b"
    ).select(boundary_diff("SECOND", "a", "b").alias("s"), boundary_diff("MINUTE", "a", "b").alias("m")).first()
    assert (row["s"], row["m"]) == (1, 0)
