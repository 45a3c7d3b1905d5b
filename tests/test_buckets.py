"""Merges that write what changed, once."""

import os

import pytest

from haulspark.sinks import buckets, tables
from haulspark.streaming import tracking

SCHEMA = "k bigint, v string, at int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs)


def test_merge_writes_only_touched_buckets(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    buckets.create(spark.range(20_000).selectExpr("id AS k", "sha2(cast(id as string), 256) AS v", "0 AS at"), table, ["k"], 32)
    before = size(tmp_path)
    done = buckets.merge(spark.createDataFrame([(5, "new", 1), (30_000, "more", 1), (5, "older", 0)], SCHEMA), table, order="at")
    assert 1 <= len(done["written"]) <= 2 and done["shared"] >= 30
    assert size(tmp_path) - before < before / 8
    got = buckets.read(spark, table)
    assert got.count() == 20_001 and rows(got.where("k in (5, 30000)")) == [(5, "new", 1), (30_000, "more", 1)]
    assert rows(buckets.read_keys(spark, table, spark.createDataFrame([(5,), (77_777,)], "k bigint"))) == [(5, "new", 1)]
    gone = buckets.merge(spark.createDataFrame([], SCHEMA), table, gone=spark.createDataFrame([(5,), (6,)], "k bigint"))
    assert gone["written"] and buckets.read(spark, table).count() == 19_999
    assert buckets.merge(spark.createDataFrame([], SCHEMA), table)["written"] == []


def test_several_rows_of_a_key_need_an_order(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], SCHEMA)
    with pytest.raises(tables.RefusedLoad, match="no order"):
        buckets.create(twice, table, ["k"])
    buckets.create(twice, table, ["k"], 4, order="at")
    assert rows(buckets.read(spark, table)) == [(1, "b", 2)]
    with pytest.raises(tables.RefusedLoad, match="no order"):
        buckets.merge(twice, table)


def test_a_bucket_may_become_empty(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    buckets.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), table, ["k"], 4)
    buckets.merge(spark.createDataFrame([], SCHEMA), table, gone=spark.createDataFrame([(1,)], "k bigint"))
    assert rows(buckets.read(spark, table)) == []
    buckets.merge(spark.createDataFrame([(1, "b", 1)], SCHEMA), table)
    assert rows(buckets.read(spark, table)) == [(1, "b", 1)]


def test_batches_that_come_again_do_nothing(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    buckets.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), table, ["k"], 4)
    sink = buckets.merge_sink(table, "s", "at")
    sink(spark.createDataFrame([(2, "b", 1)], SCHEMA), 0)
    n = len(tables._pointers(spark, table))
    sink(spark.createDataFrame([(2, "again", 9)], SCHEMA), 0)
    assert len(tables._pointers(spark, table)) == n and rows(buckets.read(spark, table)) == [(1, "a", 1), (2, "b", 1)]
    sink(spark.createDataFrame([(2, "c", 2)], SCHEMA), 1)
    assert rows(buckets.read(spark, table)) == [(1, "a", 1), (2, "c", 2)]

    events, now = f"file://{tmp_path}/e", lambda i: __import__("pyspark").sql.functions.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp")
    tables.snapshot_swap(spark.createDataFrame([], "source_id string, event_id string, first_seen timestamp, last_seen timestamp, soft_closed_at timestamp, p string"), events, min_rows=0)
    write = tracking.lifecycle_sink(events, now)
    batch = spark.createDataFrame([("s", "1", "a")], "source_id string, event_id string, p string")
    write(batch, 0)
    versions = tables._pointers(spark, events)
    write(batch, 0)
    assert tables._pointers(spark, events) == versions and tables.last_batch(spark, events, "polls") == 0
    write(batch.limit(0).unionByName(spark.createDataFrame([("s", None, None)], batch.schema)), 1)
    assert tables.current(spark, events).first()["soft_closed_at"] is not None


def test_versions_that_nobody_needs_go(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    buckets.create(spark.range(100).selectExpr("id AS k", "'x' AS v", "0 AS at"), table, ["k"], 8)
    for i in range(4):
        buckets.merge(spark.createDataFrame([(i, "y", i)], SCHEMA), table)
    want, before = rows(buckets.read(spark, table)), size(tmp_path)
    gone = buckets.collect_versions(spark, table, keep=1)
    assert gone and size(tmp_path) < before and rows(buckets.read(spark, table)) == want and len(tables._pointers(spark, table)) == 1
    assert buckets.collect_versions(spark, table, keep=1) == []
    with pytest.raises(ValueError):
        buckets.collect_versions(spark, table, keep=0)
