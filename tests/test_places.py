"""Places of values among sorted limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from playlens.functions.places import with_place
from playlens.sources import live_store


@pytest.mark.parametrize("limits", [[], ["b"], ["a", "b", "d"], list("bcdefghijk"), [*map(chr, range(97, 97 + 16))]])
def test_places_equal_a_plain_count(spark, limits):
    values = [None, "", "a", "aa", "b", "d", "k", "p", "z"]
    rows = spark.createDataFrame([(value,) for value in values], "value string")
    got = with_place(rows, "place", F.col("value"), F.array(*map(F.lit, limits)), len(limits)).collect()
    for row in got:
        assert row.place == (0 if row.value is None else sum(limit <= row.value for limit in limits))


def test_interleaved_layout_halves_its_limits(spark):
    """A row is not compared with every limit, and the layout has the rows and columns it was given."""
    rows = spark.range(300).selectExpr("concat('p', id % 40) AS player_name", "cast(id AS string) AS event_type", "id AS n")
    layout = live_store.interleaved_layout(rows, ("player_name", "event_type"))
    assert layout.columns == rows.columns
    assert "lambda" not in plan_of(layout)
    assert sorted(layout.collect()) == sorted(rows.collect())
