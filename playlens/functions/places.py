"""Places of values among sorted limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_place(rows: DataFrame, name: str, value: Column, limits: Column, most: int) -> DataFrame:
    """Adds ``name``: how many of the sorted ``limits``, ``most`` at most, are not above the value; 0 for a null value.

    Limits are halved, a column for each step, so that a row is compared with few of them and all of it is generated code.
    """
    rows = rows.withColumns({name: F.lit(0), f"{name}_limits": limits, f"{name}_value": value})
    for bit in reversed(range(most.bit_length())):
        place = F.col(name)
        reached = F.get(f"{name}_limits", place + ((1 << bit) - 1)) <= F.col(f"{name}_value")
        rows = rows.withColumn(name, place + F.when(reached, 1 << bit).otherwise(0))
    return rows.drop(f"{name}_limits", f"{name}_value")
