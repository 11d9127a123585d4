"""Global order operators against windows over the whole table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from playlens.operators.ordered import assign_interval, global_lead, global_rank, ordered_layout, segment_rank, segment_running


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, v int")


CASES = {
    "empty": [],
    "one": [3],
    "ties": [1] * 60 + [2] * 3,
    "nulls": [None, 5, None, 1, 2, None],
    "random": [random.Random(1).choice([None, *range(8)]) for _ in range(200)],
}


@pytest.mark.parametrize("partitions", [1, 25])
@pytest.mark.parametrize("case", CASES)
def test_rank_and_lead(spark, case, partitions):
    df = numbers(spark, CASES[case])
    order = [F.desc_nulls_last("v"), F.asc("id")]
    window = Window.orderBy(*order)
    want = df.select("id", "v", F.row_number().over(window).alias("rank"), F.lead("v").over(window).alias("next"))
    ranked = global_rank(df, order, partitions=partitions)
    led = global_lead(df, "v", order, "next", partitions=partitions)
    got = ranked.join(led.select("id", "next"), "id").select("id", "v", "rank", "next")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])


def test_hot_value_is_spread_over_ranges(spark):
    """One value holds every row; the unique last column still splits it."""
    df = spark.range(40000).withColumn("v", F.lit(1))
    sizes = [row["count"] for row in ordered_layout(df, ["v", "id"], partitions=8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40000 / 8


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("partitions", [1, 20])
def test_intervals(spark, closed, partitions):
    rng = random.Random(7)
    edges = sorted(rng.sample(range(300), 40))
    intervals = [(n, edges[2 * n], edges[2 * n + 1]) for n in range(20)]
    points = [(n, rng.randrange(-5, 310)) for n in range(400)]
    got = assign_interval(
        spark.createDataFrame(points, "id bigint, t int"),
        spark.createDataFrame(intervals, "name bigint, a int, b int"),
        point="t",
        start="a",
        end="b",
        point_id="id",
        carry=["name"],
        closed=closed,
        partitions=partitions,
    )
    inside = (lambda a, t, b: a <= t <= b) if closed else (lambda a, t, b: a < t < b)
    want = sorted((n, t, name) for n, t in points for name, a, b in intervals if inside(a, t, b))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("partitions", [1, 4, 30])
@pytest.mark.parametrize("keys", [[], ["k"], ["k", "m"]])
def test_running_totals_of_a_key(spark, keys, partitions):
    """One key holds half the rows, so it fills many ranges; some keys are missing."""
    rng = random.Random(8)
    rows = [(i, rng.choices(["hot", None, "a", "b"], [6, 2, 1, 1])[0], rng.choice([None, 1]), rng.choice([None, *range(5)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k string, m int, v bigint")
    layout = ordered_layout(df, [*[F.col(key).asc_nulls_first() for key in keys], "id"], partitions=partitions)
    got = segment_running(
        layout,
        keys,
        so_far={"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "x": ("xor", F.xxhash64("id")), "low": ("min", F.col("v"))},
        until={"earlier": ("max", F.col("id"))},
        from_here={"rest": ("sum", F.lit(1)), "top": ("max", F.col("v"))},
    ).drop("part", "pos")
    ahead = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = df.select(
        "*",
        F.sum(F.lit(1)).over(ahead).alias("n"),
        F.sum("v").over(ahead).alias("s"),
        F.bit_xor(F.xxhash64("id")).over(ahead).alias("x"),
        F.min("v").over(ahead).alias("low"),
        F.max("id").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.sum(F.lit(1)).over(onward).alias("rest"),
        F.max("v").over(onward).alias("top"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rank_within_a_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 != 0, F.lit("hot")).alias("k"))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("id"))).cast("bigint"))
    got = segment_rank(df, ["k"], [F.desc("id")], partitions=9)
    assert sorted(map(tuple, got.select("id", "k", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert segment_rank(df.limit(0), ["k"], ["id"]).count() == 0
