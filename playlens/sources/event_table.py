"""The event table: one append-only table for spans, metrics and logs.

Outer columns are fixed; ``record``, ``record_attributes``, ``resource_attributes``, ``scope``,
``trace`` and ``value`` are VARIANT and are read by path at query time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.functions.attributes import text
from playlens.functions.places import with_place
from playlens.vocabulary import DEFAULT_SERVICE, SERVICE_KEY

#: Rows of one range of a stored table.
RANGE_ROWS = 250_000
#: Sampled rows of a range, from which the limits of ranges follow.
RANGE_SAMPLE, SEED = 100, 20240301
COLUMNS = (
    "event_id",
    "timestamp",
    "start_timestamp",
    "record_type",
    "record",
    "record_attributes",
    "resource_attributes",
    "scope",
    "trace",
    "value",
)


def _object(**fields: Column) -> Column:
    return F.to_variant_object(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _nothing() -> Column:
    return F.lit(None).cast("variant")


def _resource(service: str) -> Column:
    return F.to_variant_object(F.struct(F.lit(service).alias(SERVICE_KEY)))


def span_records(spans: DataFrame, service: str = DEFAULT_SERVICE) -> DataFrame:
    """SPAN rows from (event_id, timestamp, name, attributes map)."""
    digest = F.md5(F.col("event_id").cast("string"))
    return spans.select(
        "event_id",
        "timestamp",
        F.col("timestamp").alias("start_timestamp"),
        F.lit("SPAN").alias("record_type"),
        _object(name=F.col("name")).alias("record"),
        F.to_variant_object("attributes").alias("record_attributes"),
        _resource(service).alias("resource_attributes"),
        _nothing().alias("scope"),
        _object(trace_id=digest, span_id=F.substring(digest, 1, 16)).alias("trace"),
        _nothing().alias("value"),
    )


def metric_records(metrics: DataFrame, service: str = DEFAULT_SERVICE, scope: str = "collector") -> DataFrame:
    """METRIC rows from (event_id, timestamp, metric_name, metric_value)."""
    return metrics.select(
        "event_id",
        "timestamp",
        F.lit(None).cast(metrics.schema["timestamp"].dataType).alias("start_timestamp"),
        F.lit("METRIC").alias("record_type"),
        _object(metric=F.struct(F.col("metric_name").alias("name"))).alias("record"),
        _nothing().alias("record_attributes"),
        _resource(service).alias("resource_attributes"),
        _object(name=F.lit(scope)).alias("scope"),
        _nothing().alias("trace"),
        F.col("metric_value").cast("variant").alias("value"),
    )


def instrument_records(points: DataFrame, service: str = DEFAULT_SERVICE, scope: str = "collector") -> DataFrame:
    """METRIC rows from (timestamp, since, metric_name, kind, labels map, value VARIANT) of cumulative instruments.

    ``since`` is when the instrument's first event came. A point has no id of its own; its id follows from its content.
    """
    content = F.xxhash64("metric_name", F.to_json("labels"), F.col("timestamp").cast("string"), F.col("value").cast("string"))
    return points.select(
        F.col("timestamp"),
        content.bitwiseAND(F.lit((1 << 63) - 1)).alias("event_id"),
        F.col("since").alias("start_timestamp"),
        F.lit("METRIC").alias("record_type"),
        _object(metric=F.struct(F.col("metric_name").alias("name"), F.col("kind").alias("type"))).alias("record"),
        F.to_variant_object("labels").alias("record_attributes"),
        _resource(service).alias("resource_attributes"),
        _object(name=F.lit(scope)).alias("scope"),
        _nothing().alias("trace"),
        "value",
    ).select(*COLUMNS)


def log_records(logs: DataFrame, service: str = DEFAULT_SERVICE) -> DataFrame:
    """LOG rows from (event_id, timestamp, severity, log_message)."""
    return logs.select(
        "event_id",
        "timestamp",
        F.lit(None).cast(logs.schema["timestamp"].dataType).alias("start_timestamp"),
        F.lit("LOG").alias("record_type"),
        _object(severity_text=F.col("severity")).alias("record"),
        _nothing().alias("record_attributes"),
        _resource(service).alias("resource_attributes"),
        _nothing().alias("scope"),
        _nothing().alias("trace"),
        F.col("log_message").cast("variant").alias("value"),
    )


def scan_service_records(
    event_table: DataFrame, service: str | None = DEFAULT_SERVICE, record_type: str | None = None
) -> DataFrame:
    """Rows of one service, and of one record type. ``record_type`` reaches the Parquet scan."""
    if record_type is not None:
        event_table = event_table.where(F.col("record_type") == record_type)
    if service is not None:
        event_table = event_table.where(text("resource_attributes", SERVICE_KEY) == service)
    return event_table


def split_by_record_type(event_table: DataFrame, service: str | None = DEFAULT_SERVICE) -> dict[str, DataFrame]:
    """One filtered scan per record type."""
    return {kind: scan_service_records(event_table, service, kind) for kind in ("SPAN", "METRIC", "LOG")}


def _range_limits(keys: DataFrame, count: int, ranges: int) -> Column:
    """The sorted limits between ``ranges`` ranges of about equally many of the ``count`` keys, as a value. They say where rows lie, no more."""
    sample = keys.where(F.rand(SEED) < F.lit(min(1.0, ranges * RANGE_SAMPLE / max(1, count))))
    ordered = sample.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    limit = lambda i: F.get("keys", F.floor(F.size("keys") * i / ranges).cast("int"))
    return ordered.select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), limit)).scalar()


def write_event_table(
    event_table: DataFrame, path: str, mode: str = "append", *, by_day: bool = True, by_service: bool = False
) -> None:
    """Store records by type, and by day, in time order; ``by_service`` puts a folder of each service above.

    Range partitioning on the type and the time gives every file a short span of time, which
    Parquet statistics can skip, and splits a day that holds much of the data over many tasks.
    There are as many ranges as keep each at about ``RANGE_ROWS`` rows, since a task sorts its range in memory; the order
    is that of the folders, so that the writer need not sort again. The limits come from a sample of the ordering columns alone:
    Spark's own range partitioning would build every VARIANT for it, and again for the shuffle.
    Without ``by_day`` there is a folder per type only, for tables with few rows a day.
    """
    rows = event_table.withColumn("event_date", F.to_date("timestamp")) if by_day else event_table
    folders = ["record_type", "event_date"] if by_day else ["record_type"]
    if by_service:
        rows, folders = rows.withColumn("service", text("resource_attributes", SERVICE_KEY)), ["service", *folders]
    first = [name for name in folders if name != "event_date"]
    count = event_table.count()
    ranges = max(2, rows.sparkSession.sparkContext.defaultParallelism, math.ceil(count / RANGE_ROWS))
    order = F.struct(*first, "timestamp", "event_id")
    (
        with_place(rows, "event_range", order, _range_limits(rows.select(order.alias("key")), count, ranges), ranges - 1)
        .repartitionById(ranges, "event_range")
        .drop("event_range")
        .sortWithinPartitions(*folders, "timestamp")
        .write.mode(mode)
        .partitionBy(*folders)
        .parquet(path)
    )


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
