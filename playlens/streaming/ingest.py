"""Continuous ingest: request log to event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playlens.sources.ingest import build_spans, ingest_requests
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE

EVERY_5_SECONDS = {"processingTime": "5 seconds"}


def stream_ingest(
    requests: DataFrame,
    *,
    path: str,
    checkpoint: str,
    service: str = DEFAULT_SERVICE,
    prefix: str = DEFAULT_PREFIX,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Parse requests as they come and append them to the event table, by type and day.

    Stateless: tasks parse the files they read, and nothing is shuffled.
    """
    spans = build_spans(requests, service=service, prefix=prefix)
    return (
        spans.withColumn("event_date", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("record_type", "event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .start()
    )


def stream_quarantine(
    requests: DataFrame, *, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append the requests whose payload cannot be parsed to ``path``, by day. The counterpart of ``stream_ingest``."""
    _, quarantine = ingest_requests(requests)
    return (
        quarantine.withColumn("event_date", F.to_date("ts"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .start()
    )
