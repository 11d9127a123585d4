"""Declared relationships between tables: key checks and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Each left key is spread over so many tasks; the right side, one row per key, is repeated as often.
SALTS = 8


def _complete(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key can match: equality never matches a missing value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in on]))


def check_primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: keys, keys with several rows, keys with a missing part, and the verdict."""
    missing = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in columns])
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("n"))
        .agg(
            F.count("*").alias("keys"),
            F.count_if(F.col("n") > 1).alias("duplicate_keys"),
            F.count_if(missing).alias("incomplete_keys"),
        )
        .withColumn("is_unique", F.col("duplicate_keys") == 0)
    )


def check_cardinality(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys with several rows on each side, and the kind of relationship."""

    def duplicates(df: DataFrame):
        counts = _complete(df, on).groupBy(*on).agg(F.count("*").alias("n"))
        return counts.agg(F.count_if(F.col("n") > 1).alias("n")).scalar()

    name = F.concat(
        F.when(F.col("left_duplicates") > 0, "many").otherwise("one"),
        F.lit("_to_"),
        F.when(F.col("right_duplicates") > 0, "many").otherwise("one"),
    )
    return (
        left.sparkSession.range(1)
        .select(duplicates(left).alias("left_duplicates"), duplicates(right).alias("right_duplicates"))
        .withColumn("relationship", name)
        .withColumn("accepted", F.col("right_duplicates") == 0)
    )


def join_relationship(left: DataFrame, right: DataFrame, on: list[str], *, salts: int = SALTS) -> DataFrame:
    """Inner join of a many-to-one relationship; the run fails if ``right`` repeats a key.

    Each side is read once and nothing runs before the result is asked for. The rows of a key that holds much of the left
    side, equal ones too, are dealt in turn over ``salts`` tasks; 1 leaves them together and the right side as it is.
    Both sides are sorted and merged: a stored right side is judged by its packed size, without the repetition, so it would be
    gathered in the driver however many keys it has.
    """
    left, right = _complete(left, on), _complete(right, on)
    others = [name for name in right.columns if name not in on]
    kept = [F.col(f"__row.{name}").alias(name) for name in others]
    rows = right.groupBy(*on).agg(F.count("*").alias("__n"), F.any_value(F.struct(*others)).alias("__row"))
    fault = f"not a many-to-one relationship: the right side repeats values of {on}"
    single = rows.where(F.assert_true(F.col("__n") == 1, F.lit(fault)).isNull()).select(*on, *kept)
    salted = single.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return dealt.join(salted.hint("merge"), [*on, "__salt"]).drop("__salt")
