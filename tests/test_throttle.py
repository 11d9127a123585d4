from __future__ import annotations

import random

import pytest

from helpers import spans_frame
from playlens.operators.throttle import key_throttle


def kept(rows, gap_ms):
    """The definition: one after the other, per player and key."""
    last, result = {}, []
    for row in sorted(rows, key=lambda r: (r["t"], r["event_id"])):
        key = (row["player_name"], row["key_name"])
        if key not in last or round(row["t"] * 1000) - last[key] > gap_ms:
            last[key] = round(row["t"] * 1000)
            result.append(row["event_id"])
    return sorted(result)


def presses(times, player="a", key="left", first_id=1):
    return [
        {"t": t, "event": "key_press", "player_name": player, "key_name": key, "event_id": first_id + i}
        for i, t in enumerate(times)
    ]


def test_compares_with_the_last_kept_event(spark):
    rows = presses([0, 0.3, 0.5, 0.501, 0.9, 1.002])
    got = sorted(row["event_id"] for row in key_throttle(spans_frame(spark, rows)).collect())
    assert got == [1, 4, 6]


@pytest.mark.parametrize("seed", range(8))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, number = [], 1
    span = rng.choice([3, 30, 300])
    for _ in range(400):
        player = rng.choices(["hot", None, "c", "d"], [6, 2, 1, 1])[0]
        rows += presses([rng.randrange(span * 1000) / 1000], player, rng.choice(["left", "up"]), number)
        number += 1
    # slices shorter than, equal to and longer than the gap
    slice_ms = rng.choice([200, 500, 1700, 60000])
    frame = spans_frame(spark, rows).repartition(5)
    got = sorted(row["event_id"] for row in key_throttle(frame, slice_ms=slice_ms).collect())
    assert got == kept(rows, 500)


def test_slices_larger_than_an_arrow_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(3)
        rows = presses([rng.randrange(20000) / 1000 for _ in range(300)])
        rows += presses([rng.randrange(20000) / 1000 for _ in range(60)], "b", "up", 1000)
        got = sorted(row["event_id"] for row in key_throttle(spans_frame(spark, rows), slice_ms=5000).collect())
        assert got == kept(rows, 500)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_large_ids_stay_exact(spark):
    rows = presses([0, 5], first_id=(1 << 60) + 1)
    got = sorted(row["event_id"] for row in key_throttle(spans_frame(spark, rows)).collect())
    assert got == [(1 << 60) + 1, (1 << 60) + 2]
