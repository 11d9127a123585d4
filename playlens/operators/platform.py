"""Container metrics and service logs per time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens import vocabulary as v
from playlens.functions.predicates import contains_text, in_range
from playlens.functions.timefns import local_text, slice_minutes


def _bucketed(
    rows: DataFrame,
    aggregates: dict[str, Column],
    *,
    metrics: tuple[str, ...] = (),
    name: str = "minute",
    bucket: int = 1,
    zone: str | None = None,
    local_group: bool = False,
    as_of=None,
    minutes: int | None = None,
    start=None,
    end=None,
    strict: bool = False,
) -> DataFrame:
    """Aggregate rows of a time range per bucket.

    With ``zone`` the bucket is shown as local text. Grouping stays on the UTC bucket, so the two
    passes of the repeated hour in autumn remain apart; ``local_group`` merges them instead.
    """
    rows = in_range(rows, as_of=as_of, minutes=minutes, start=start, end=end, strict=strict)
    if metrics:
        rows = rows.where(F.col("metric_name").isin(*metrics))
    rows = rows.withColumn(name, slice_minutes("timestamp", bucket))
    if zone and local_group:
        rows = rows.withColumn(name, local_text(name, zone))
    result = rows.groupBy(name).agg(*[column.alias(alias) for alias, column in aggregates.items()]).orderBy(name)
    return result.withColumn(name, local_text(name, zone)) if zone and not local_group else result


def _max_of(name: str) -> Column:
    return F.max(F.when(F.col("metric_name") == name, F.col("metric_value")))


def cpu_usage(metrics: DataFrame, **when) -> DataFrame:
    """Average and peak CPU in percent."""
    return _bucketed(
        metrics,
        {
            "avg_cpu_pct": F.round(F.avg("metric_value") * 100, 2),
            "max_cpu_pct": F.round(F.max("metric_value") * 100, 2),
        },
        metrics=(v.CPU,),
        **when,
    )


def memory_usage(metrics: DataFrame, **when) -> DataFrame:
    """Average and peak memory in MB."""
    return _bucketed(
        metrics,
        {
            "avg_memory_mb": F.round(F.avg("metric_value") / v.BYTES_PER_MB, 1),
            "max_memory_mb": F.round(F.max("metric_value") / v.BYTES_PER_MB, 1),
        },
        metrics=(v.MEMORY,),
        **when,
    )


def network_ingress(metrics: DataFrame, **when) -> DataFrame:
    """Peak open connections and connection rate, side by side."""
    return _bucketed(
        metrics,
        {"active_connections": _max_of(v.CONNECTIONS), "connections_per_sec": _max_of(v.CONNECTION_RATE)},
        metrics=(v.CONNECTIONS, v.CONNECTION_RATE),
        **when,
    )


def network_connections(metrics: DataFrame, **when) -> DataFrame:
    """Peak open connections as a whole number."""
    return _bucketed(
        metrics,
        {"active_connections": F.max(F.round("metric_value").cast("bigint"))},
        metrics=(v.CONNECTIONS,),
        **when,
    )


def collector_throughput(metrics: DataFrame, **when) -> DataFrame:
    """Spans started and spans alive in the collector."""
    return _bucketed(
        metrics,
        {"spans_started": _max_of(v.SPANS_STARTED), "spans_live": _max_of(v.SPANS_LIVE)},
        metrics=(v.SPANS_STARTED, v.SPANS_LIVE),
        **when,
    )


def log_health(logs: DataFrame, *, bucket: int = 5, name: str = "period", **when) -> DataFrame:
    """Log lines, and those that mention an error or a warning, per bucket."""
    return _bucketed(
        logs,
        {
            "log_count": F.count("*"),
            "error_count": F.count(F.when(contains_text("log_message", "ERROR"), 1)),
            "warn_count": F.count(F.when(contains_text("log_message", "WARN"), 1)),
        },
        bucket=bucket,
        name=name,
        **when,
    )
