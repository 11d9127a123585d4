"""Tables that batches write: versions of a whole, rows by key that are updated in place, and a log that only grows.

Plain Parquet folders have no transactions, so all keep a manifest that names the content a reader may see. A batch
writes beside that content and commits by writing the manifest, as one file, last. The manifest has two slots which batches
write in turn; a batch that fails, at any point, leaves the other slot and all that it names as they were. A batch that runs
again after its commit finds its own number there and does nothing: batches are numbered by one checkpoint, so a table belongs
to one checkpoint for ever. All reads and writes are Spark's.

Nothing is ever deleted but what a later batch writes over: a keyed table holds ``VERSIONS`` versions of a bucket and a log its
``RING`` last batches a second time. A reader must end before the content that it opened is written over.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRIES = "batch bigint, name int, value int, note string"
COMMITTED = -1  # an entry of its own: a manifest may name no content
VERSIONS = 3
#: Batches of a log that are merged into one part.
PART = 64
RING = 2 * PART


@dataclass(frozen=True)
class Manifest:
    """The newest committed batch and what it names."""

    batch: int
    entries: dict[int, int]
    note: str | None = None

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        try:
            # A slot that is just written over may vanish between its listing and its reading; the other one is whole.
            rows = spark.read.schema(ENTRIES).option("ignoreMissingFiles", "true").parquet(f"{path}/manifest").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        batch = max((row.batch for row in rows), default=-1)
        rows = [row for row in rows if row.batch == batch]
        note = next((row.note for row in rows if row.name == COMMITTED), None)
        return Manifest(batch, {row.name: row.value for row in rows if row.name != COMMITTED}, note)

    @staticmethod
    def commit(spark: SparkSession, path: str, batch: int, entries: dict[int, int], note: str | None = None) -> None:
        rows = [
            F.struct(
                F.lit(batch).cast("bigint").alias("batch"),
                F.lit(name).alias("name"),
                F.lit(value).alias("value"),
                F.lit(note if name == COMMITTED else None).cast("string").alias("note"),
            )
            for name, value in {COMMITTED: 0, **entries}.items()
        ]
        manifest = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
        manifest.write.mode("overwrite").parquet(f"{path}/manifest/slot={batch % 2}")


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key in hash buckets. A batch rewrites the buckets that its keys fall into and leaves the others.

    ``spread`` lists the expressions that choose the bucket, for instance the hour of a minute, so that a batch touches few.
    A bucket is one task's work: take as many buckets as keep it small.
    """

    path: str
    keys: tuple[str, ...]
    spread: tuple[str, ...] = ()
    buckets: int = 32

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.expr(name) for name in self.spread or self.keys]), F.lit(self.buckets)).cast("int")

    def _rows(self, spark: SparkSession, held: Manifest, buckets: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/data/key_version={held.entries[bucket]}/key_bucket={bucket}" for bucket in sorted(buckets)]
        schema = StructType.fromJson(json.loads(held.note))
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(schema.names)

    def upsert(self, rows: DataFrame, batch: int, merge: dict[str, Column]) -> bool:
        """Merge ``rows`` into the table; ``merge`` has an aggregate for each column that is no key. False if it was done before."""
        spark = rows.sparkSession
        held = Manifest.read(spark, self.path)
        if batch <= held.batch:
            return False
        fresh = rows.select(*self.keys, *merge, self._bucket().alias("key_bucket")).persist()
        touched = [row.key_bucket for row in fresh.select("key_bucket").distinct().collect()]
        versions = {bucket: (held.entries.get(bucket, -1) + 1) % VERSIONS for bucket in touched}
        if touched:
            old = [bucket for bucket in touched if bucket in held.entries]
            both = fresh.unionByName(self._rows(spark, held, old)) if old else fresh
            # Grouped where the buckets are: one shuffle, and a file for each bucket.
            merged = both.repartition(len(touched), "key_bucket").groupBy("key_bucket", *self.keys)
            version = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])[F.col("key_bucket")]
            (
                merged.agg(*[column.alias(name) for name, column in merge.items()])
                .withColumn("key_version", version)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("key_version", "key_bucket")
                .parquet(f"{self.path}/data")
            )
        Manifest.commit(spark, self.path, batch, held.entries | versions, held.note or fresh.schema.json())
        fresh.unpersist()
        return True

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows as of the last committed batch."""
        held = Manifest.read(spark, self.path)
        return self._rows(spark, held, held.entries).drop("key_bucket")

    def read_for(self, rows: DataFrame) -> DataFrame | None:
        """The stored rows in the buckets that ``rows`` have keys in; None before the first batch."""
        spark = rows.sparkSession
        held = Manifest.read(spark, self.path)
        if held.batch < 0:
            return None
        touched = {row.key_bucket for row in rows.select(self._bucket().alias("key_bucket")).distinct().collect()}
        return self._rows(spark, held, touched & set(held.entries)).drop("key_bucket")


@dataclass(frozen=True)
class Log:
    """Rows in the order of batches. Every ``PART`` batches become one part; newer ones lie in a ring of folders."""

    path: str

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add the rows of a batch. False if it was done before."""
        spark = rows.sparkSession
        held = Manifest.read(spark, self.path)
        if batch <= held.batch:
            return False
        rows.write.mode("overwrite").parquet(self._slot(batch))
        parts = self._parts(held)
        if (batch + 1) // PART > parts:
            tail = self._tail(spark, range(parts * PART, batch + 1))
            tail.write.mode("overwrite").parquet(f"{self.path}/parts/part={parts}")
            parts += 1
        Manifest.commit(spark, self.path, batch, {0: parts})
        return True

    def _slot(self, batch: int) -> str:
        return f"{self.path}/tail/slot={batch % RING}"

    def _parts(self, held: Manifest) -> int:
        return held.entries.get(0, 0)

    def _tail(self, spark: SparkSession, batches: range) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/tail").parquet(*map(self._slot, batches)).drop("slot")

    def read_batch(self, spark: SparkSession, batch: int) -> DataFrame:
        """The rows of one of the newest batches."""
        return self._tail(spark, range(batch, batch + 1))

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows up to the last committed batch."""
        held = Manifest.read(spark, self.path)
        if held.batch < 0:
            raise ValueError(f"no batch was committed to {self.path}")
        parts, frames = self._parts(held), []
        if parts:
            paths = [f"{self.path}/parts/part={number}" for number in range(parts)]
            frames.append(spark.read.option("basePath", f"{self.path}/parts").parquet(*paths).drop("part"))
        if parts * PART <= held.batch:
            frames.append(self._tail(spark, range(parts * PART, held.batch + 1)))
        return frames[0].unionByName(frames[1]) if len(frames) > 1 else frames[0]
