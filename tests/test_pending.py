"""Streams beside snapshot versions: any order of files, replays, folding."""

import itertools
import os
import random

from pyspark.sql import functions as F

from stockroom.operators import apply_quantity_events
from stockroom.plans.inventory import maintain_inventory
from stockroom.sources import fold_pending, read_ledger, read_snapshot, snapshot_versions, write_snapshot
from stockroom.sources.pending import add_events, add_rows
from stockroom.streaming import file_stream, run_available, stream_apply_events, stream_net_quantity, stream_summary

from conftest import rows

EV = "event_id long, ts long, row_id long, delta int"
INV = "Item string, Quantity long, RowID long"


def _inventory(spark, root, n=6):
    inv = spark.createDataFrame([(f"i{k}", 2, k) for k in range(n)], INV)
    write_snapshot(inv, root, "inventory", version=0)
    return inv


def _events(seed, n=120, ids=6):
    rng = random.Random(seed)
    return [(k, rng.randrange(1000), rng.randrange(ids), rng.choice([1, 1, -1])) for k in range(n)]


def _feed(spark, root, parts, **kw):
    """One file per part, read by one micro-batch each, in the given order."""
    src = os.path.join(root, "in")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EV).coalesce(1).write.parquet(f"{src}/f{k}")
        run_available(stream_apply_events(file_stream(spark, src + "/*", spark.createDataFrame([], EV).schema, max_files_per_trigger=1),
                                          root, "inventory", os.path.join(root, "ck"), interval=None, slot_width=100, **kw))


def test_events_in_any_order_of_files_equal_the_batch(spark, tmp_dir):
    events = _events(1)
    inv = spark.createDataFrame([(f"i{k}", 2, k) for k in range(6)], INV)
    batch = rows(apply_quantity_events(inv, spark.createDataFrame(events, EV)))
    assert 0 < len(batch) < 6  # some rows reach zero, some stay
    by_time = sorted(events, key=lambda e: e[1])
    thirds = [by_time[:40], by_time[40:80], by_time[80:]]
    for k, order in enumerate([(2, 1, 0), (1, 2, 0), (0, 1, 2)]):
        root = os.path.join(tmp_dir, f"r{k}")
        _inventory(spark, root)
        _feed(spark, root, [thirds[i] for i in order])
        assert rows(read_snapshot(spark, root, "inventory")) == batch
        assert snapshot_versions(spark, root, "inventory") == [0]  # nothing was rewritten


def test_interleaved_slots_folding_and_replay(spark, tmp_dir):
    events = _events(2)
    inv = _inventory(spark, tmp_dir)
    df = spark.createDataFrame(events, EV)
    args = (tmp_dir, "inventory", ("ts", "event_id"), "RowID", "Quantity", "row_id", "delta", 100)
    halves = [df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1")]  # both span all slots
    add_events(halves[0], "q", 0, *args)
    add_events(halves[1], "q", 1, *args)
    add_events(halves[1], "q", 1, *args)  # replayed before anything is folded
    want = rows(apply_quantity_events(inv, df))
    assert rows(read_snapshot(spark, tmp_dir, "inventory")) == want
    assert fold_pending(spark, tmp_dir, "inventory") == 1
    assert rows(read_ledger(spark, tmp_dir, "inventory", 1)) == [("q", 1)]
    add_events(halves[1], "q", 1, *args)  # replayed after
    assert rows(read_snapshot(spark, tmp_dir, "inventory")) == want
    more = spark.createDataFrame([(1000, 5000, k, 1) for k in range(6)], EV)
    add_events(more, "q", 2, *args)
    maintain_inventory(spark, tmp_dir, "inventory", events=more)
    assert {r.RowID: r.Quantity for r in read_snapshot(spark, tmp_dir, "inventory").collect()} == {
        r[2]: r[1] + 2 for r in want}
    assert rows(read_ledger(spark, tmp_dir, "inventory", 2)) == [("q", 2)]


def test_an_incomplete_version_or_sum_is_passed_over(spark, tmp_dir):
    _inventory(spark, tmp_dir)
    os.makedirs(os.path.join(tmp_dir, "inventory", "v=1"))
    os.makedirs(os.path.join(tmp_dir, "inventory", "pending", "base=0", "sums", "seq=0"))
    assert snapshot_versions(spark, tmp_dir, "inventory") == [0]
    assert read_snapshot(spark, tmp_dir, "inventory").count() == 6
    assert write_snapshot(read_snapshot(spark, tmp_dir, "inventory"), tmp_dir, "inventory", base=0) == 2


def test_net_stream_writes_changed_ids_only_and_folds(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    parts = [[(k, k, k % 3 if k % 2 else 7, 1) for k in range(20)], [(90, 1, 2, 5)], [(91, 2, 8, -1)], [(92, 3, None, 4)], [(93, 4, 2, 1)]]
    sizes = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EV).coalesce(1).write.parquet(f"{src}/f{k}")
        run_available(stream_net_quantity(file_stream(spark, src + "/*", spark.createDataFrame([], EV).schema), tmp_dir, "net",
                                          os.path.join(tmp_dir, "ck"), interval=None, fold_every=3))
        net = spark.createDataFrame(list(itertools.chain(*parts[:k + 1])), EV).groupBy("row_id").agg(F.sum("delta").alias("net"))
        assert rows(read_snapshot(spark, tmp_dir, "net")) == rows(net)
        for base in ("none", "1"):
            path = os.path.join(tmp_dir, "net", "pending", f"base={base}", "rows", f"seq={k if base == 'none' else k - 3}")
            if os.path.isdir(path):
                sizes.append(spark.read.parquet(path).count())
    assert sizes == [4, 1, 1, 1]  # the third trigger was folded into version 1
    assert snapshot_versions(spark, tmp_dir, "net") == [1]


def test_old_versions_of_a_summary_go(spark, tmp_dir):
    for k in range(7):
        add_rows(spark.createDataFrame([("a", k), (f"k{k}", 1)], "key string, total long"), tmp_dir, "s", "key", 2, 1)
    assert len(snapshot_versions(spark, tmp_dir, "s")) == 1
    assert rows(read_snapshot(spark, tmp_dir, "s")) == sorted([("a", 6), *((f"k{k}", 1) for k in range(7))])


def test_summary_stream_with_null_keys(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    for k, part in enumerate([[("a", 1, 1), (None, 2, 2)], [(None, 3, 3)]]):
        spark.createDataFrame(part, INV).coalesce(1).write.parquet(f"{src}/f{k}")
    stream = file_stream(spark, src + "/*", spark.createDataFrame([], INV).schema, max_files_per_trigger=1)
    run_available(stream_summary(stream, "Item", "Quantity", tmp_dir, "s", os.path.join(tmp_dir, "ck"), interval=None))
    assert rows(read_snapshot(spark, tmp_dir, "s")) == [("a", 1), (None, 5)]
