from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from playlens.operators.relationships import check_cardinality, check_primary_key, join_relationship

LEFT = "id bigint, k string, j string"
RIGHT = "k string, j string, v bigint"


def test_join_with_a_hot_key_and_missing_keys(spark):
    left = [(i, "hot", "x") for i in range(3000)] + [(3000 + i, f"k{i}", "x") for i in range(1500)]
    left += [(9000, None, "x"), (9001, "k1", None), (9002, "absent", "x")]
    right = [("hot", "x", 1), (None, "x", 2), ("k1", None, 3)] + [(f"k{i}", "x", i) for i in range(1000)]
    got = join_relationship(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k", "j"])
    values = {(k, j): v for k, j, v in right if k and j}
    want = sorted((k, j, i, values[k, j]) for i, k, j in left if (k, j) in values)
    assert sorted(map(tuple, got.select("k", "j", "id", "v").collect())) == want


@pytest.mark.parametrize("salts", [1, 3])
def test_equal_rows_are_dealt_over_the_salts(spark, salts):
    left, right = spark.createDataFrame([(1, "hot", "x")] * 60, LEFT), spark.createDataFrame([("hot", "x", 1)], RIGHT)
    assert join_relationship(left, right, ["k", "j"], salts=salts).count() == 60


def test_the_repeated_right_side_is_not_gathered_in_the_driver(spark, tmp_path):
    """A stored right side of many keys is small when packed; eight times as many rows were broadcast."""
    spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("x").alias("j"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/right")
    right = spark.read.parquet(f"{tmp_path}/right")
    left = spark.createDataFrame([(i, f"k{i * 7}", "x") for i in range(3000)], LEFT)
    got = join_relationship(left, right, ["k", "j"])
    assert {(r.id, r.v) for r in got.collect()} == {(i, i * 7) for i in range(20_000 // 7 + 1)}
    assert "Broadcast" not in plan_of(got) and "SortMergeJoin" in plan_of(got)


def test_many_to_many_is_refused(spark):
    right = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], RIGHT)
    left = spark.createDataFrame([(1, "a", "x")], LEFT)
    joined = join_relationship(left, right, ["k", "j"])  # builds without a job
    with pytest.raises(Exception, match="many-to-one"):
        joined.collect()
    row = check_cardinality(left.union(left), right, ["k", "j"]).first()
    assert (row["relationship"], row["accepted"]) == ("many_to_many", False)


def test_primary_key(spark):
    row = check_primary_key(spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("a", "x", 3)], RIGHT), ["k", "j"]).first()
    assert (row["keys"], row["duplicate_keys"], row["incomplete_keys"], row["is_unique"]) == (2, 1, 1, False)


def test_each_side_is_read_once(spark, sf_dir):
    from playlens.plans import registry
    from playlens.sources.bindings import Telemetry

    seen = spark.sparkContext.accumulator(0)
    telemetry = Telemetry(spark, sf_dir)
    rows = telemetry.events.count()

    @F.udf("long")
    def counted(value):
        seen.add(1)
        return value

    telemetry.events = telemetry.events.withColumn("event_id", counted("event_id"))
    tables = [registry.defined(telemetry, name) for name in ("powerups", "deaths_by_level")]
    frame = join_relationship(*tables, ["player_name", "level"])
    assert seen.value == 0
    frame.collect()
    assert seen.value <= 2 * 2 * rows  # two sides; each reads spans of two services
