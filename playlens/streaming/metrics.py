"""Metric export: the collector's instruments as METRIC records of the event table.

Nine counters and a histogram are cumulative, as an exporter sends them: a point holds all events of its series from the first
one to the end of its interval. A series has a point for each interval in which something happened to it.

A micro-batch counts its events per series and interval, in the map tasks first, so a series that most events belong to is no
hot spot. Running totals over the intervals of the batch are added to the totals of earlier batches, which lie in a keyed table.
Points go to a log, then the totals are brought up to date. An event that comes late, for an interval before the last point of its series,
counts from that point on: the point appears once more with a larger value, and no total ever falls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playlens.operators.aggregates import INSTRUMENTS, counted, duration_buckets
from playlens.sources.event_table import instrument_records
from playlens.sources.ingest import request_attributes
from playlens.streaming.ingest import EVERY_5_SECONDS
from playlens.sources.stored import KeyedTable, Log
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE, HISTOGRAM_BOUNDS

EXPORT_SECONDS = 5
DURATION = "session.duration"
SERIES = ("instrument", "label_1", "label_2")


def _merges(sums: list[str]) -> dict[str, Column]:
    """Sums, and the first event, last point, least and largest value of a series."""
    return {name: F.sum(name) for name in sums} | {name: F.min(name) for name in ("since", "low")} | {name: F.max(name) for name in ("upto", "high")}


@dataclass(frozen=True)
class MetricExport:
    """The exported points in ``folder``, and the totals that they have reached."""

    folder: str
    service: str = DEFAULT_SERVICE
    prefix: str = DEFAULT_PREFIX
    seconds: int = EXPORT_SECONDS
    bounds: tuple[int, ...] = HISTOGRAM_BOUNDS

    @property
    def _points(self) -> Log:
        return Log(f"{self.folder}/points")

    @property
    def _totals(self) -> KeyedTable:
        return KeyedTable(f"{self.folder}/totals", SERIES, buckets=16)

    @property
    def _sums(self) -> list[str]:
        return ["total", "amount", *[f"bucket_{i}" for i in range(len(self.bounds) + 1)]]

    def _partial(self, attributes: DataFrame) -> DataFrame:
        """One row per series and interval of a batch. Counters have neither amounts nor buckets."""
        end = F.window("timestamp", f"{self.seconds} seconds")["end"].alias("upto")
        none = F.lit(None)
        labelled = counted(attributes).select(*SERIES, end, "timestamp", none.cast("double").alias("value"), none.cast("int").alias("at"))
        durations = duration_buckets(attributes, self.bounds, also=("timestamp",)).select(
            F.lit(DURATION).alias("instrument"),
            none.cast("string").alias("label_1"),
            none.cast("string").alias("label_2"),
            end,
            "timestamp",
            F.col("duration").alias("value"),
            F.col("bucket").alias("at"),
        )
        return (
            labelled.unionByName(durations)
            .groupBy(*SERIES, "upto")
            .agg(
                F.count("*").alias("total"),
                F.sum("value").alias("amount"),
                *[F.count(F.when(F.col("at") == i, 1)).alias(f"bucket_{i}") for i in range(len(self.bounds) + 1)],
                F.min("timestamp").alias("since"),
                F.min("value").alias("low"),
                F.max("value").alias("high"),
            )
        )

    def _cumulative(self, partial: DataFrame, held: DataFrame | None) -> DataFrame:
        """Points of a batch, with what the series held before."""
        merges = _merges(self._sums)
        if held is None:
            held = partial.limit(0)
        before = held.select(*[F.col(name).alias(f"held_{name}") for name in (*SERIES, *merges)])
        same = [F.col(name).eqNullSafe(F.col(f"held_{name}")) for name in SERIES]
        moved = partial.join(before, same, "left").withColumn("upto", F.greatest("upto", "held_upto"))
        once = moved.groupBy(*SERIES, "upto").agg(
            *[column.alias(name) for name, column in merges.items() if name != "upto"],
            *[F.first(f"held_{name}").alias(f"held_{name}") for name in merges],
        )
        so_far = Window.partitionBy(*SERIES).orderBy("upto").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = {name: F.sum(name).over(so_far) for name in self._sums}
        running |= {name: F.min(name).over(so_far) for name in ("since", "low")} | {"high": F.max("high").over(so_far)}
        joined = {
            name: F.coalesce(column + F.col(f"held_{name}"), column, f"held_{name}") if name in self._sums else column for name, column in running.items()
        }
        joined |= {name: F.least(running[name], f"held_{name}") for name in ("since", "low")}
        joined["high"] = F.greatest(running["high"], "held_high")
        return once.select(*SERIES, "upto", *[column.alias(name) for name, column in joined.items()])

    def _records(self, points: DataFrame) -> DataFrame:
        labels = {instrument: (first, second) for instrument, first, second in INSTRUMENTS.values()}
        # The attribute that a label comes from has the producer's name.
        sent = {"key_name": "key", "powerup_type": "type"}

        def name_of(position: int) -> Column:
            pairs = [F.lit(x) for key, names in labels.items() if names[position] for x in (key, sent.get(names[position], names[position]))]
            return F.try_element_at(F.create_map(*pairs), F.col("instrument"))

        pairs = F.array(
            F.struct(name_of(0).alias("key"), F.col("label_1").alias("value")), F.struct(name_of(1).alias("key"), F.col("label_2").alias("value"))
        )
        is_histogram = F.col("instrument") == DURATION
        histogram = F.struct(
            F.col("total").alias("count"),
            F.col("amount").alias("sum"),
            F.col("low").alias("min"),
            F.col("high").alias("max"),
            F.array(*[f"bucket_{i}" for i in range(len(self.bounds) + 1)]).alias("bucket_counts"),
            F.array(*[F.lit(bound) for bound in self.bounds]).alias("explicit_bounds"),
        )
        return instrument_records(
            points.select(
                F.col("upto").alias("timestamp"),
                "since",
                F.concat(F.lit(self.prefix), "instrument").alias("metric_name"),
                F.when(is_histogram, "histogram").otherwise("sum").alias("kind"),
                F.map_from_entries(F.filter(pairs, lambda pair: pair["key"].isNotNull())).alias("labels"),
                F.when(is_histogram, F.to_variant_object(histogram)).otherwise(F.col("total").cast("variant")).alias("value"),
            ),
            self.service,
        )

    def write(self, attributes: DataFrame, number: int) -> None:
        """One micro-batch. Points are committed first, then the totals that they reach."""
        partial = self._partial(attributes).persist()
        held = self._totals.read_for(partial)
        self._points.append(self._records(self._cumulative(partial, held)), number)
        self._totals.upsert(partial, number, _merges(self._sums))
        partial.unpersist()

    def stream(self, attributes: DataFrame, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Export the instruments of a stream of attribute rows."""
        return (
            attributes.writeStream.foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or EVERY_5_SECONDS))
            .start()
        )

    def stream_requests(self, requests: DataFrame, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Export the instruments of a stream of requests."""
        return self.stream(request_attributes(requests, prefix=self.prefix), checkpoint=checkpoint, trigger=trigger)

    def read(self, spark: SparkSession) -> DataFrame:
        """The METRIC records, to be read beside the spans: ``spans.unionByName(export.read(spark))`` is the event table."""
        return self._points.read(spark)
