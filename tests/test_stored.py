"""Keyed tables and logs that micro-batches write."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playlens.session import new_path
from playlens.sources import stored
from playlens.sources.stored import KeyedTable, Log, Manifest

SCHEMA = "name string, place int, n bigint, latest int"
MERGE = {"n": F.sum, "latest": F.max}


def merges():
    return {name: function(name) for name, function in MERGE.items()}


def rows_of(seed, names=40):
    rng = random.Random(seed)
    return [(rng.choice([None, *map(str, range(names))]), rng.randrange(3), rng.randrange(9), rng.randrange(99)) for _ in range(50)]


def merged(batches):
    sums, latest = Counter(), {}
    for rows in batches:
        for name, place, n, at in rows:
            sums[name, place] += n
            latest[name, place] = max(at, latest.get((name, place), at))
    return {(*key, n, latest[key]) for key, n in sums.items()}


def grouped(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).groupBy("name", "place").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), F.lit(1).alias("more"))


def content(frame):
    rows = [tuple(row) for row in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("buckets", [1, 7, 200])
def test_batches_merge_by_key(spark, buckets):
    table = KeyedTable(new_path(spark, "keyed"), ("name", "place"), buckets=buckets)
    batches = [rows_of(seed) for seed in range(6)]
    for number, rows in enumerate(batches):
        assert table.upsert(grouped(spark, rows), number, merges())
        assert content(table.read(spark)) == merged(batches[: number + 1])


def test_a_batch_that_runs_again_changes_nothing(spark):
    table = KeyedTable(new_path(spark, "again"), ("name", "place"), buckets=4)
    first, second = rows_of(1), rows_of(2)
    table.upsert(grouped(spark, first), 0, merges())
    table.upsert(grouped(spark, second), 1, merges())
    for number, rows in ((1, second), (0, first)):
        assert not table.upsert(grouped(spark, rows), number, merges())
    assert content(table.read(spark)) == merged([first, second])


def test_a_batch_that_fails_leaves_the_table_as_it_was(spark, monkeypatch):
    table = KeyedTable(new_path(spark, "failed"), ("name", "place"), buckets=4)
    first, second = rows_of(1), rows_of(2)
    table.upsert(grouped(spark, first), 0, merges())
    commit = Manifest.commit
    monkeypatch.setattr(Manifest, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(grouped(spark, second), 1, merges())
    assert content(table.read(spark)) == merged([first])
    monkeypatch.setattr(Manifest, "commit", commit)
    table.upsert(grouped(spark, second), 1, merges())
    assert content(table.read(spark)) == merged([first, second])


def test_a_batch_rewrites_its_buckets_only_and_readers_read_one_version(spark):
    table = KeyedTable(new_path(spark, "buckets"), ("name", "place"), buckets=32)
    table.upsert(grouped(spark, rows_of(1)), 0, merges())
    held = Manifest.read(spark, table.path).entries
    files = None
    for number in range(1, 9):
        table.upsert(grouped(spark, [("7", 1, 1, 1)]), number, merges())
        now = Manifest.read(spark, table.path).entries
        assert sum(now[bucket] != version for bucket, version in held.items()) <= 1
        read = table.read(spark).inputFiles()
        assert files is None or len(read) == files  # whatever the number of batches
        files = len(read)
    on_disk = spark.read.parquet(f"{table.path}/data").select("key_version", "key_bucket").distinct().count()
    assert on_disk <= len(held) + stored.VERSIONS


def test_stored_rows_of_some_keys(spark):
    table = KeyedTable(new_path(spark, "some"), ("name", "place"), buckets=64)
    asked = spark.createDataFrame([("3", 1, 0, 0), (None, 2, 0, 0)], SCHEMA)
    assert table.read_for(asked) is None
    rows = rows_of(1, names=400)
    table.upsert(grouped(spark, rows), 0, merges())
    some = content(table.read_for(asked))
    assert some <= merged([rows]) and len(some) < len(merged([rows]))
    assert {row for row in merged([rows]) if row[:2] in {("3", 1), (None, 2)}} <= some


def test_a_batch_without_rows(spark):
    table = KeyedTable(new_path(spark, "none"), ("name", "place"))
    table.upsert(grouped(spark, []), 0, merges())
    assert table.read(spark).columns == ["name", "place", "n", "latest"] and table.read(spark).count() == 0
    table.upsert(grouped(spark, rows_of(1)), 1, merges())
    table.upsert(grouped(spark, []), 2, merges())
    assert content(table.read(spark)) == merged([rows_of(1)])


def test_log_merges_batches_into_parts(spark, monkeypatch):
    monkeypatch.setattr(stored, "PART", 3)
    monkeypatch.setattr(stored, "RING", 6)
    log = Log(new_path(spark, "log"))
    with pytest.raises(ValueError):
        log.read(spark)
    for number in range(10):
        frame = spark.createDataFrame([(number, i) for i in range(number % 4)], "batch int, i int")
        assert log.append(frame, number) and not log.append(frame, number)
        assert sorted(map(tuple, log.read(spark).collect())) == sorted((b, i) for b in range(number + 1) for i in range(b % 4))
    assert content(log.read_batch(spark, 9)) == {(9, 0)}
    assert len({name.rsplit("/", 2)[1] for name in log.read(spark).inputFiles()}) == 4  # three parts and the newest batch


def test_log_shows_committed_batches_only(spark, monkeypatch):
    log = Log(new_path(spark, "open"))
    log.append(spark.range(3).toDF("i"), 0)
    monkeypatch.setattr(Manifest, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.append(spark.range(5).toDF("i"), 1)
    assert log.read(spark).count() == 3
