"""Stored tables with a folder per day, read no further than a question needs.

What is newest lies in the last folders, so newest-first lists open these first and go back in time, with twice as many days in
each step, until they are full. Which days there are is known from the folders' names. Counts come from the footers of the files, by
Parquet's aggregate push-down, and times from the first or last day alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAY = "event_date"


_SESSIONS: dict[tuple, SparkSession] = {}


def _variant(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application with other settings, made once; the given one stays as it is."""
    key = (spark.sparkContext.applicationId, *sorted(settings.items()))
    if key not in _SESSIONS:
        _SESSIONS[key] = spark.newSession()
        # Folders are listed by so many tasks, not by one task each.
        listing = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}
        for name, value in {"spark.sql.session.timeZone": "UTC", **listing, **settings}.items():
            _SESSIONS[key].conf.set(name, value)
    return _SESSIONS[key]


def _reader(spark: SparkSession, columns: str | None) -> DataFrameReader:
    return spark.read.schema(StructType.fromJson(json.loads(columns))) if columns else spark.read


def footer_counts(spark: SparkSession, path: str, folders: tuple[str, ...], *by: str, columns: str | None = None) -> DataFrame:
    """Rows of a Parquet table (``total``), for each value of the columns ``by``. Reads footers only.

    ``folders`` names all partition columns in their order: Parquet answers a count for each folder, or one for the whole table.
    ``columns`` is the schema in JSON; without it the table must have a file.
    """
    session = _variant(
        spark,
        **{"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"},
    )
    found = _reader(session, columns).parquet(path).groupBy(*folders).agg(F.count("*").alias("rows"))
    return found.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))


@dataclass
class DayTable:
    """A Parquet table in ``path`` with a column ``timestamp`` and a folder for each ``event_date``, its day, as it is when opened.

    ``fixed`` restricts it to partitions above those of the days, such as one record type. Rows without a time are in a folder of their own,
    which counts as the oldest.
    """

    spark: SparkSession
    path: str
    fixed: tuple[tuple[str, str], ...] = ()
    columns: str | None = None  # the schema in JSON, if it is known; a table without rows needs it
    folders: tuple[str, ...] = ()  # the partition columns above the day, in their order

    @cached_property
    def _rows(self) -> DataFrame:
        rows = self._open(_reader(self.spark, self.columns))
        for name, value in self.fixed:
            rows = rows.where(F.col(name) == value)
        return rows

    def _open(self, reader: DataFrameReader) -> DataFrame:
        """All rows of the folders of the ``fixed`` values: those of other values are not even listed."""
        fixed = dict(self.fixed)
        last = max((at for at, name in enumerate(self.folders, start=1) if name in fixed), default=0)
        # A name that a path would show in another form is left to the filter.
        if last and all(re.fullmatch(r"[A-Za-z0-9_.-]+", value) for value in fixed.values()):
            parts = [f"{name}={fixed.get(name, '*')}" for name in self.folders[:last]]
            try:
                return reader.option("basePath", self.path).parquet("/".join([self.path, *parts]))
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return reader.parquet(self.path)

    def rows(self) -> DataFrame:
        return self._rows.drop(DAY)

    @cached_property
    def days(self) -> list[date]:
        """The days that have a folder, the newest first. No file is opened."""
        session = _variant(self.spark, **{"spark.sql.optimizer.metadataOnly": "true"})
        days = replace(self, spark=session)._rows.select(DAY).distinct().collect()
        return sorted((row[0] for row in days if row[0] is not None), reverse=True)

    def since(self, start: datetime) -> DataFrame:
        """Rows from ``start`` on, from the folders of these days."""
        return self._rows.where((F.col(DAY) >= F.lit(start.date())) & (F.col("timestamp") >= self._time(start))).drop(DAY)

    def between(self, start: datetime, end: datetime) -> DataFrame:
        """Rows from ``start`` to before ``end``, from the folders of these days."""
        days = F.col(DAY).between(F.lit(start.date()), F.lit(end.date()))
        return self._rows.where(days & (F.col("timestamp") >= self._time(start)) & (F.col("timestamp") < self._time(end))).drop(DAY)

    def _time(self, value: datetime) -> Column:
        return F.lit(value.isoformat(sep=" ")).cast(self._rows.schema["timestamp"].dataType)

    def newest(self, limit: int, chosen: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The newest ``limit`` rows that ``chosen`` leaves, newest first; ties by the largest ``event_id``.

        At most ``limit`` rows reach the driver in a step, and the steps together read at most twice what is needed.
        """
        days, take = self.days, 1
        while True:
            rows = self._rows.where(F.col(DAY) >= F.lit(days[take - 1])) if take < len(days) else self._rows
            found = chosen(rows.drop(DAY)).orderBy(F.desc_nulls_last("timestamp"), F.desc("event_id")).limit(limit)
            rows = found.collect()
            if len(rows) == limit or take >= len(days):
                return self.spark.createDataFrame(rows, found.schema)
            take *= 2

    @cached_property
    def latest_time(self) -> datetime | None:
        """The newest time; only the newest day is read."""
        return self._edge(F.max("timestamp"), newest=True)

    @cached_property
    def first_time(self) -> datetime | None:
        """The oldest time; only the oldest day is read."""
        return self._edge(F.min("timestamp"), newest=False)

    def _edge(self, aggregate: Column, *, newest: bool) -> datetime | None:
        if not self.days:
            return None
        day = self.days[0] if newest else self.days[-1]
        # Without zone, so that the driver's own zone has no say.
        return self._rows.where(F.col(DAY) == F.lit(day)).agg(aggregate.cast("timestamp_ntz")).first()[0]

    def last(self, *, as_of: datetime | None = None, hours: int = 0, minutes: int = 0) -> DataFrame:
        """Rows of the last ``hours`` and ``minutes`` before ``as_of`` or the newest row, from the folders of these days."""
        now = as_of or self.latest_time
        return self._rows.drop(DAY).limit(0) if now is None else self.since(now - timedelta(hours=hours, minutes=minutes))

    def count(self) -> int:
        """Rows, from the footers."""
        names = [name for name, _ in self.fixed]
        folders = (*(self.folders or names), DAY)
        counts = footer_counts(self.spark, self.path, folders, *names, columns=self.columns).collect()
        return sum(row.total for row in counts if all(row[name] == value for name, value in self.fixed))
