from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from playlens.operators import projections
from playlens.plans import feeds
from playlens.session import new_path
from playlens.sources import event_table
from playlens.sources.bindings import OTHER_SERVICE, Telemetry


def record(spark, attributes='{"coins":"5"}', resource='{"snow.service.name":"GAME_SERVICE"}', name="game.death"):
    return spark.sql(
        """SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS timestamp, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS start_timestamp,
 'SPAN' AS record_type, parse_json(:name) AS record, parse_json(:attributes) AS record_attributes,
 parse_json(:resource) AS resource_attributes, parse_json('null') AS scope, parse_json('null') AS trace, parse_json('null') AS value""",
        args={"name": f'{{"name":"{name}"}}', "attributes": attributes, "resource": resource},
    )


@pytest.mark.parametrize("coins", ['"None"', '"12.6x"', "null", '""'])
def test_bad_numbers_are_missing(spark, coins):
    row = projections.spans(record(spark, f'{{"coins":{coins}}}')).first()
    assert row["coins"] is None


def test_absent_attribute_is_missing(spark):
    assert projections.spans(record(spark, "{}")).first()["coins"] is None


def test_service_is_one_dotted_key(spark):
    nested = '{"snow":{"service":{"name":"GAME_SERVICE"}}}'
    assert projections.spans(record(spark, resource=nested)).count() == 0
    assert projections.spans(record(spark)).count() == 1


def test_prefix_ends_at_the_dot(spark):
    assert projections.spans(record(spark, name="gamex.death")).count() == 0


def test_other_services_are_left_out(spark, sf_dir):
    t = Telemetry(spark, sf_dir)
    other = projections.spans(t.event_table, service=OTHER_SERVICE)
    assert 0 < other.count() < t.spans.count()
    assert t.spans.count() == t.events.count()


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    path = new_path(spark, "event_table")
    event_table.write_event_table(Telemetry(spark, sf_dir).event_table, path)
    return event_table.read_event_table(spark, path)


def test_filters_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    events = projections.game_events(stored).where(F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    plan = plan_of(events.select("player_name"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(record_type" in plan and "(record_type" in plan
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters")[1]
    assert "GreaterThanOrEqual(timestamp" in pushed and "GAME_SERVICE" in pushed and "StringStartsWith" in pushed
    read = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "value" not in read and "scope" not in read and "trace" not in read


def test_lists_are_top_k(spark, stored):
    for rows in (feeds.newest(projections.game_events(stored), 25), feeds.event_feed(projections.game_events(stored))):
        plan = plan_of(rows)
        assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_leaderboard_numbers_only_the_best(spark, stored):
    from playlens.operators.leaderboard import leaderboard

    plan = plan_of(leaderboard(projections.game_events(stored), as_of=datetime(2024, 1, 30)))
    assert "TakeOrderedAndProject" in plan or "Limit" in plan.split("Window")[1]


def test_ranges_of_a_written_table_have_bounded_rows(spark, sf_dir, monkeypatch):
    """A task sorts few rows however large the table is: the number of files follows from the rows."""
    monkeypatch.setattr(event_table, "RANGE_ROWS", 100)
    records = Telemetry(spark, sf_dir).event_table
    path = new_path(spark, "ranged")
    event_table.write_event_table(records, path, by_day=False)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes < 1000


def test_records_are_built_once_for_a_stored_table(spark):
    """Limits of ranges come from the ordering columns, not from whole records."""
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def attributes(event_id):
        built.add(1)
        return '{"coins":"5"}'

    rows = record(spark).drop("event_id").crossJoin(spark.range(500).select(F.col("id").alias("event_id")))
    rows = rows.withColumn("record_attributes", F.parse_json(attributes("event_id")))
    path = new_path(spark, "built_once")
    event_table.write_event_table(rows.select(*event_table.COLUMNS), path)
    assert built.value == 500
    assert event_table.read_event_table(spark, path).count() == 500


def test_awkward_records_are_stored_whole(spark):
    """Null times, ids and types, equal rows, and no rows at all."""
    known = record(spark)
    rows = known
    for name in ("timestamp", "event_id", "record_type"):
        rows = rows.unionByName(known.withColumn(name, F.lit(None).cast(known.schema[name].dataType)))
    rows = rows.unionByName(known)
    for given, count in ((rows, 5), (known.limit(0), 0)):
        path = new_path(spark, "awkward")
        event_table.write_event_table(given, path, by_service=True)
        if count:
            assert event_table.read_event_table(spark, path).count() == count


def test_events_are_dealt_before_records_are_built(spark, tmp_path):
    """Events of one file and row group become records in many tasks; rows are the same."""
    fields = ["event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, event_id) AS ts", "event_id % 9 AS user_id"]
    fields += ["'view' AS event_type", "1.5D AS value", "concat('{\"k\": ', event_id % 7, '}') AS props"]
    events = spark.range(400).withColumnRenamed("id", "event_id").selectExpr(*fields)
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    telemetry = Telemetry(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = telemetry.spread_event_table()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spread.where("record_type = 'LOG'").select(F.input_file_name()).distinct().count()
    assert files > 1
    plain = lambda rows: sorted(map(str, rows.select("event_id", "timestamp", "record_type", F.to_json("record_attributes"), F.to_json("resource_attributes")).collect()))
    assert plain(spread) == plain(telemetry.event_table)
    given = Telemetry(spark, str(tmp_path), event_table=spread)
    assert given.spread_event_table() is spread
