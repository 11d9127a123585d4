"""The key-repeat throttle on a stream.

A micro-batch runs the batch operator, which cuts the time of a key into slices: a key that holds much of the batch is spread
over many tasks, and only the short reduced form of its slices passes through one of them. The chain goes on from the time
that each key was last kept, which lies in a keyed table of which a batch reads and rewrites the buckets of its keys. So no
watermark drops a row: an event counts as late only if one of its key was kept after it, as for the batch operator's chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playlens.functions.predicates import is_event
from playlens.operators.throttle import HOUR_MS, KEYS, key_throttle
from playlens.streaming.live_tables import EVERY_MINUTE
from playlens.sources.stored import KeyedTable, Log
from playlens.vocabulary import KEY_REPEAT_MS


@dataclass(frozen=True)
class ThrottledKeys:
    """The kept events of a stream in ``folder``, and the last one of each key."""

    folder: str
    gap_ms: int = KEY_REPEAT_MS
    slice_ms: int = HOUR_MS

    @property
    def _kept(self) -> Log:
        return Log(f"{self.folder}/kept")

    @property
    def _last(self) -> KeyedTable:
        return KeyedTable(f"{self.folder}/last", KEYS)

    def write(self, batch: DataFrame, number: int) -> None:
        """One micro-batch. Kept events are committed first, then the state they lead to."""
        spark, batch = batch.sparkSession, batch.where(is_event("key_press")).persist()
        # The table still has the state before this batch until that is committed, however often the batch runs.
        before = self._last.read_for(batch)
        self._kept.append(key_throttle(batch, gap_ms=self.gap_ms, slice_ms=self.slice_ms, kept_before=before), number)
        kept = self._kept.read_batch(spark, number)
        times = kept.groupBy(*KEYS).agg(F.max(F.unix_millis(F.col("timestamp").cast("timestamp"))).alias("last_ms"))
        self._last.upsert(times, number, {"last_ms": F.max("last_ms")})
        batch.unpersist()

    def stream(self, spans: DataFrame, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Keep the table fresh from a stream of spans."""
        return (
            spans.writeStream.foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or EVERY_MINUTE))
            .start()
        )

    def read(self, spark: SparkSession) -> DataFrame:
        return self._kept.read(spark)
