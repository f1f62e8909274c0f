"""Structured Streaming jobs equal their batch forms."""

import os

from pyspark.sql import functions as F

from stockroom.operators import apply_quantity_events
from stockroom.sources import read_snapshot, snapshot_versions, write_snapshot
from stockroom.streaming import (file_stream, run_available, stream_apply_events, stream_net_quantity,
                                 stream_summary)

from conftest import rows

EV = "event_id long, ts long, row_id long, delta int"
INV = "Item string, Quantity long, RowID long"


def _events(spark, folder):
    ev1 = [(1, 10, 1, -1), (2, 11, 2, 1), (3, 12, 3, -1)]
    ev2 = [(4, 20, 1, 1), (5, 21, 2, -1), (6, 22, 2, -1), (7, 23, 3, 1)]
    spark.createDataFrame(ev1, EV).coalesce(1).write.parquet(os.path.join(folder, "f1"))
    spark.createDataFrame(ev2, EV).coalesce(1).write.parquet(os.path.join(folder, "f2"))
    schema = spark.createDataFrame([], EV).schema
    return ev1 + ev2, schema


def test_stream_net_quantity_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    all_rows, schema = _events(spark, src)
    stream = file_stream(spark, src + "/*", schema, max_files_per_trigger=1)
    run_available(stream_net_quantity(stream, tmp_dir, "net", os.path.join(tmp_dir, "ck"), interval=None))
    batch = spark.createDataFrame(all_rows, EV).groupBy("row_id").agg(F.sum("delta").alias("net"))
    assert rows(read_snapshot(spark, tmp_dir, "net")) == rows(batch)


def test_stream_summary_complete_mode(spark, tmp_dir):
    src = os.path.join(tmp_dir, "inv")
    spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", None, 3)], INV).write.parquet(src)
    schema = spark.createDataFrame([], INV).schema
    stream = file_stream(spark, src, schema)
    run_available(stream_summary(stream, "Item", "Quantity", tmp_dir, "summary", os.path.join(tmp_dir, "ck"),
                                 interval=None))
    assert rows(read_snapshot(spark, tmp_dir, "summary")) == [("a", 1), ("b", 2)]


def test_stream_apply_events_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    all_rows, schema = _events(spark, src)
    inv = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], INV)
    root = os.path.join(tmp_dir, "snap")
    write_snapshot(inv, root, "inventory", version=0)
    stream = file_stream(spark, src + "/*", schema, max_files_per_trigger=1)
    run_available(stream_apply_events(stream, root, "inventory", os.path.join(tmp_dir, "ck"), interval=None))
    batch = apply_quantity_events(inv, spark.createDataFrame(all_rows, EV))
    assert rows(read_snapshot(spark, root, "inventory")) == rows(batch)
    # Row 1: -1 then +1 -> gone; row 2: +1, -1, -1 -> gone at 0; row 3: -1 -> gone.
    assert rows(batch) == []


def test_stream_apply_events_replay_is_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    _, schema = _events(spark, src)
    inv = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], INV)
    root = os.path.join(tmp_dir, "snap")
    write_snapshot(inv, root, "inventory", version=0)
    ck = os.path.join(tmp_dir, "ck")
    run_available(stream_apply_events(file_stream(spark, src + "/*", schema, max_files_per_trigger=1),
                                      root, "inventory", ck, interval=None))
    first = rows(read_snapshot(spark, root, "inventory"))
    # Same checkpoint, no new files: nothing to apply, nothing changes.
    run_available(stream_apply_events(file_stream(spark, src + "/*", schema, max_files_per_trigger=1),
                                      root, "inventory", ck, interval=None))
    assert rows(read_snapshot(spark, root, "inventory")) == first
    assert first == [("a", 5, 1), ("b", 4, 2), ("c", 5, 3)]


def test_maintenance_and_streams_share_a_table(spark, tmp_dir):
    """Interleaved writers on one root, a fresh checkpoint and a replayed
    batch: no event is lost or applied twice."""
    from stockroom.plans.inventory import maintain_inventory
    from stockroom.sources import update_snapshot
    from stockroom.operators.changes import apply_quantity_events

    spec = "event_id long, ts long, row_id long, delta int"
    root = os.path.join(tmp_dir, "snap")
    write_snapshot(spark.createDataFrame([("a", 5, 1)], INV), root, "inventory", version=0)
    ev = lambda n, d: spark.createDataFrame([(n, n, 1, d)], spec)

    def run(folder, ck):
        run_available(stream_apply_events(file_stream(spark, folder + "/*", ev(0, 1).schema, max_files_per_trigger=1), root,
                                          "inventory", os.path.join(tmp_dir, ck), interval=None))

    one, two = os.path.join(tmp_dir, "one"), os.path.join(tmp_dir, "two")
    maintain_inventory(spark, root, "inventory", events=ev(1, 1))            # 6, version 1
    ev(2, 1).coalesce(1).write.parquet(f"{one}/b1")
    run(one, "ck1")                                                          # 7
    maintain_inventory(spark, root, "inventory", events=ev(3, 1))            # 8
    ev(4, 1).coalesce(1).write.parquet(f"{one}/b2")
    run(one, "ck1")                                                          # 9, second micro-batch
    run(one, "ck1")                                                          # nothing new
    ev(5, 1).coalesce(1).write.parquet(f"{two}/b1")
    run(two, "ck2")                                                          # 10, fresh checkpoint
    assert rows(read_snapshot(spark, root, "inventory")) == [("a", 10, 1)]
    versions = snapshot_versions(spark, root, "inventory")
    replay = update_snapshot(spark, root, "inventory", lambda t: apply_quantity_events(t, ev(9, 1)), stream=("q", 3))
    assert replay == versions[-1] + 1
    assert update_snapshot(spark, root, "inventory", lambda t: apply_quantity_events(t, ev(9, 1)), stream=("q", 3)) == replay
    assert rows(read_snapshot(spark, root, "inventory")) == [("a", 11, 1)]


def test_stream_summary_refreshes_as_files_arrive(spark, tmp_dir):
    src = os.path.join(tmp_dir, "inv")
    os.makedirs(src)
    schema = spark.createDataFrame([], INV).schema
    spark.createDataFrame([("a", 1, 1)], INV).write.parquet(os.path.join(src, "batch1"))
    stream = file_stream(spark, os.path.join(src, "*"), schema)
    q = stream_summary(stream, "Item", "Quantity", tmp_dir, "summary", os.path.join(tmp_dir, "ck"),
                       interval="1 second", keep_versions=2)
    try:
        q.processAllAvailable()
        assert rows(read_snapshot(spark, tmp_dir, "summary")) == [("a", 1)]
        spark.createDataFrame([("a", 2, 2), ("b", 5, 3)], INV).write.parquet(os.path.join(src, "batch2"))
        q.processAllAvailable()
        assert rows(read_snapshot(spark, tmp_dir, "summary")) == [("a", 3), ("b", 5)]
        assert len(snapshot_versions(spark, tmp_dir, "summary")) <= 2
    finally:
        q.stop()
