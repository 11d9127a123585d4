"""Flat, typed views of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.attributes import double, integer, text
from playlens.functions.predicates import has_prefix
from playlens.sources.event_table import scan_service_records
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE


def _named(df: DataFrame, prefix: str) -> DataFrame:
    """The events that start with ``prefix``, named as all operators know them: with the default prefix in its place."""
    chosen = df.where(has_prefix(prefix))
    if prefix == DEFAULT_PREFIX:
        return chosen  # names stay as stored, so filters on them reach the scan
    bare = F.substring("event_type", F.lit(len(prefix) + 1), F.char_length("event_type"))
    return chosen.withColumn("event_type", F.concat(F.lit(DEFAULT_PREFIX), bare))


def game_events(event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE, prefix: str = DEFAULT_PREFIX):
    """Game spans as text columns; the source of every live table."""
    return _named(
        scan_service_records(event_table, service, "SPAN").select(
            "event_id",
            "timestamp",
            text("record", "name").alias("event_type"),
            text("record_attributes", "player_name").alias("player_name"),
            text("record_attributes", "level").alias("level"),
            text("record_attributes", "coins").alias("coins"),
            text("record_attributes", "lives").alias("lives"),
            text("record_attributes", "key").alias("key_name"),
            text("record_attributes", "type").alias("powerup_type"),
            text("record_attributes", "session_duration").alias("duration"),
            text("record_attributes", "session_id").alias("session_id"),
        ),
        prefix,
    )


def spans(event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Game spans with typed numbers; text that is not a number becomes NULL."""
    return _named(
        scan_service_records(event_table, service, "SPAN").select(
            "event_id",
            "timestamp",
            text("record", "name").alias("event_type"),
            text("record_attributes", "player_name").alias("player_name"),
            text("record_attributes", "level").alias("level"),
            integer("record_attributes", "coins").alias("coins"),
            integer("record_attributes", "lives").alias("lives"),
            text("record_attributes", "key").alias("key_name"),
            text("record_attributes", "type").alias("powerup_type"),
            double("record_attributes", "session_duration").alias("session_duration"),
            text("record_attributes", "session_id").alias("session_id"),
        ),
        prefix,
    )


def game_logs(event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE) -> DataFrame:
    return scan_service_records(event_table, service, "LOG").select(
        "event_id",
        "timestamp",
        text("value").alias("log_message"),
        text("record", "severity_text").alias("severity"),
    )


def game_metrics(event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE) -> DataFrame:
    return scan_service_records(event_table, service, "METRIC").select(
        "event_id",
        "timestamp",
        text("record", "metric", "name").alias("metric_name"),
        double("value").alias("metric_value"),
        text("scope", "name").alias("scope"),
        "record_attributes",
    )


def histogram_points(event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE) -> DataFrame:
    """The points of exported histograms."""
    rows = scan_service_records(event_table, service, "METRIC").where(text("record", "metric", "type") == "histogram")
    return rows.select(
        "event_id",
        "timestamp",
        text("record", "metric", "name").alias("metric_name"),
        F.try_variant_get("value", "$.count", "bigint").alias("total"),
        double("value", "sum").alias("sum_value"),
        double("value", "min").alias("min_value"),
        double("value", "max").alias("max_value"),
        F.try_variant_get("value", "$.bucket_counts", "array<bigint>").alias("bucket_counts"),
    )


def game_traces(event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE) -> DataFrame:
    return scan_service_records(event_table, service, "SPAN").select(
        "event_id",
        "timestamp",
        "start_timestamp",
        text("record", "name").alias("span_name"),
        text("record_attributes", "player_name").alias("player_name"),
        "record_attributes",
        text("trace", "trace_id").alias("trace_id"),
        text("trace", "span_id").alias("span_id"),
    )


def attribute_frame(
    event_table: DataFrame, *, service: str | None = DEFAULT_SERVICE, prefix: str = DEFAULT_PREFIX
) -> DataFrame:
    """Event name and the attributes the instruments are labelled with."""
    rows = scan_service_records(event_table, service, "SPAN").select(
        "event_id",
        "timestamp",
        text("record", "name").alias("event_type"),
        text("record_attributes", "level").alias("level"),
        text("record_attributes", "difficulty").alias("difficulty"),
        text("record_attributes", "key").alias("key_name"),
        text("record_attributes", "type").alias("powerup_type"),
        double("record_attributes", "duration").alias("duration"),
        double("record_attributes", "session_duration").alias("session_duration"),
    )
    return rows if prefix == DEFAULT_PREFIX else _named(rows, prefix)

