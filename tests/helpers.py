"""Small frames for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

SPANS_SCHEMA = (
    "event_id bigint, timestamp timestamp_ntz, event_type string, player_name string, level string, coins int, "
    "lives int, key_name string, powerup_type string, session_duration double, session_id string"
)
NAMES = [part.split()[0] for part in SPANS_SCHEMA.split(", ")]
ORIGIN = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return ORIGIN + timedelta(milliseconds=round(seconds * 1000))


def spans_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Spans from dicts with ``t`` (seconds) and ``event``; ids follow the list unless given."""
    data = []
    for number, row in enumerate(rows, start=1):
        full = dict.fromkeys(NAMES)
        full.update(event_id=number, timestamp=at(row["t"]), event_type="game." + row["event"])
        full.update({key: value for key, value in row.items() if key in NAMES})
        data.append(tuple(full[name] for name in NAMES))
    return spark.createDataFrame(data, SPANS_SCHEMA)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
