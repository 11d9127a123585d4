"""Reading documents and running Arrow code over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from playlens.session import new_path

#: Python's ``bytes.split()`` splits at exactly these: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch while whole texts travel; a batch is the most a Python worker holds.
TEXT_ROWS = 200
#: Rows of a stored file, where the number of rows is known and they are numbers.
ROWS_A_FILE = 25_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, UPPER, LOWER)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def arrow_rows(schema: pa.Schema, make: Callable[[pa.RecordBatch], dict | None]):
    """A function for ``mapInArrow``: ``make`` gives the columns for a small batch of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = make(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is written inside gives Python at most ``rows`` rows at once: ten thousand whole texts would lie in the
    executor's Arrow buffers and again in the worker, in each of its tasks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_few(df: DataFrame, name: str, rows: int, costly: bool = False) -> DataFrame:
    """``store`` for at most ``rows`` rows: in no more files than they fill, since the folders and files of a write cost more than
    few rows do. The last stage has as many tasks as files then, unless it is ``costly``: its rows are dealt out anew."""
    files = max(1, -(-rows // ROWS_A_FILE))
    if not costly:
        df = df.coalesce(files)
    elif files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(files)
    return store(df, name)


def sampled(key: Column, share: float) -> Column:
    """Whether a row is in a sample of this share of the keys, by all bits of their hash, so that no share is too small."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(min((1 << 63) - 1, int(share * (1 << 63))))


def spread(df: DataFrame, *names: str) -> DataFrame:
    """``df`` over as many tasks as shuffles have, even if it is small: for rows that grow many times in the next step."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)


def window_of(*names: str) -> WindowSpec:
    """All rows that agree in ``names``."""
    return Window.partitionBy(*names)
