"""Live tables: definition, stored layout and full refresh."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playlens.functions.places import with_place
from playlens.operators import aggregates
from playlens.session import materialise
from playlens.sources.day_table import DAY, DayTable
from playlens.sources.stored import Manifest

#: Versions of a table that are kept. A reader has until the last of them is written over.
KEPT = 8
#: Ranges of a cluster column, as a power of two, whose bits are interleaved.
BITS = 6
SAMPLE = 4096


@dataclass(frozen=True)
class LiveTable:
    """How a live table follows from the game events, and the columns it is clustered by.

    ``by_day``: stored in a folder per day of its ``timestamp``, interleaved inside a day.
    """

    build: Callable[[DataFrame], DataFrame]
    cluster_by: tuple[str, ...]
    by_day: bool = False


LIVE_TABLES = {
    "game_events": LiveTable(lambda events: events, ("player_name", "event_type", "timestamp"), by_day=True),
    "event_timeline": LiveTable(aggregates.event_timeline, ("event_type", "minute")),
    "key_presses": LiveTable(aggregates.key_presses, ("player_name", "key_name")),
    "deaths_by_level": LiveTable(aggregates.deaths_by_level, ("player_name", "level")),
    "powerups": LiveTable(aggregates.powerups, ("player_name", "powerup_type")),
    "player_sessions": LiveTable(aggregates.player_sessions, ("player_name", "session_start")),
}


def cluster_layout(table: DataFrame, cluster_by: tuple[str, ...]) -> DataFrame:
    """Rows ranged and sorted by the cluster columns, so that Parquet statistics can skip files."""
    return table.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)


def _ranked(table: DataFrame, name: str) -> Column:
    """A cluster column as a value that the driver can sort like Spark."""
    is_time = table.schema[name].dataType.typeName().startswith("timestamp")
    return F.unix_micros(F.col(name).cast("timestamp")) if is_time else F.col(name)


def interleaved_layout(table: DataFrame, cluster_by: tuple[str, ...], first: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """Rows clustered by all columns alike: a filter on any one of them skips files, not only one on the first.

    Each column is cut into ranges of equally many rows, and the bits of a row's ranges are interleaved; rows are ranged by the
    result, within each value of ``first``. The limits come from a sample of ``SAMPLE`` rows, as those of any range
    partitioning do; they decide where rows lie, not what the table holds. The rows are stored first, so that their source is read once.
    """
    rows = materialise(table, "unclustered")
    columns = {name: _ranked(table, name) for name in cluster_by}
    sample = rows.select(*[column.alias(name) for name, column in columns.items()]).orderBy(F.rand()).limit(SAMPLE).collect()
    places, mixed_rows = [], rows
    for name, column in columns.items():
        values = sorted(row[name] for row in sample if row[name] is not None)
        limits = sorted({values[len(values) * i >> bits] for i in range(1, 1 << bits)}) if values else []
        place = f"cluster_place_{len(places)}"
        mixed_rows = with_place(mixed_rows, place, column, F.array(*map(F.lit, limits)), len(limits))
        places.append(F.col(place).cast("bigint"))
    mixed = [
        F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)), bit * len(places) + number)
        for bit in range(bits)
        for number, place in enumerate(places)
    ]
    order = [*first, "cluster_mix", *cluster_by]
    mixed_rows = mixed_rows.withColumn("cluster_mix", reduce(lambda a, b: a.bitwiseOR(b), mixed)).select(*table.columns, "cluster_mix")
    return mixed_rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*table.columns)


def write_live_table(table: DataFrame, path: str, cluster_by: tuple[str, ...], *, by_day: bool = False) -> None:
    """Write a new version beside the old ones, then name it in the manifest.

    Readers see the version that was newest when they opened the table, whole, until ``KEPT`` more were written. Versions are
    numbered one after the other; a table has one writer at a time.
    """
    spark = table.sparkSession
    number = Manifest.read(spark, path).batch + 1
    if by_day:
        layout = interleaved_layout(table.withColumn(DAY, F.to_date("timestamp")), cluster_by, first=(DAY,))
        writer = layout.write.partitionBy(DAY)
    else:
        layout = cluster_layout(table, cluster_by)
        writer = layout.write
    writer.mode("overwrite").parquet(_version(path, number))
    Manifest.commit(spark, path, number, {}, layout.schema.json())


def _version(path: str, number: int) -> str:
    return f"{path}/version={number % KEPT}"


def version_path(spark: SparkSession, folder: str, name: str) -> str:
    """Where the newest version is."""
    return _version(f"{folder}/{name}", Manifest.read(spark, f"{folder}/{name}").batch)


def scan_live_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The newest version."""
    held = Manifest.read(spark, f"{folder}/{name}")
    schema = StructType.fromJson(json.loads(held.note))
    rows = spark.read.schema(schema).parquet(_version(f"{folder}/{name}", held.batch))
    return rows.drop(DAY) if DAY in schema.names else rows


def day_table(spark: SparkSession, folder: str, name: str = "game_events") -> DayTable:
    """The newest version of a table that is stored by day."""
    held = Manifest.read(spark, f"{folder}/{name}")
    return DayTable(spark, _version(f"{folder}/{name}", held.batch), columns=held.note)


def refresh_live_tables(game_events: DataFrame, folder: str, names=tuple(LIVE_TABLES)) -> dict[str, DataFrame]:
    """Rebuild the live tables in ``folder``.

    The event table is projected once: ``game_events`` is stored first, and the five aggregates
    read the columns they need from that copy.
    """
    spark = game_events.sparkSession
    table = LIVE_TABLES["game_events"]
    write_live_table(game_events, f"{folder}/game_events", table.cluster_by, by_day=table.by_day)
    stored = scan_live_table(spark, folder, "game_events")
    for name in names:
        if name != "game_events":
            table = LIVE_TABLES[name]
            write_live_table(table.build(stored), f"{folder}/{name}", table.cluster_by)
    return {name: scan_live_table(spark, folder, name) for name in names}
