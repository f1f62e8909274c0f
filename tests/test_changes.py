"""Duplicate merging, upserts and quantity events: fixtures and properties."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.operators import (append_and_collapse, apply_quantity_events, collapse_exact, collapse_items,
                                 running_quantity, upsert_items)

from conftest import rows

INV = "Item string, Quantity long, Comments string, Section string, `Estimated Price` double, RowID long"
INC = "Item string, Quantity long, Comments string, Section string, `Estimated Price` double, seq long"
EV = "event_id long, ts long, row_id long, delta int"


def test_collapse_exact_first_section_wins(spark):
    df = spark.createDataFrame([
        ("usb a to usb a", 1, None, "Cables and Adapters", None, 1),
        ("usb a to usb a", 2, None, "Other", None, 2),
        ("usb a to usb a", 4, "", "Other", None, 3),
    ], INV)
    out = collapse_exact(df, "RowID")
    assert rows(out) == [("usb a to usb a", "", 4, "Other"), ("usb a to usb a", None, 3, "Cables and Adapters")]


def test_collapse_items_normalised_key(spark):
    df = spark.createDataFrame([
        ("Panasonic TV ", 1, None, "TVs", 10.0, 5),
        ("panasonic tv", 1, "", "Audio and Video Equipment", None, 2),
        ("other", None, None, "X", None, 3),
        ("other", 2, None, "X", None, 4),
    ], INV)
    out = collapse_items(df)
    assert rows(out) == [("other", None, None, "X", None, 3),
                         ("panasonic tv", 2, "", "Audio and Video Equipment", None, 2)]


def test_upsert_fixtures(spark):
    existing = spark.createDataFrame([
        ("Dock", 1, None, "Laptop Accessories", 50.0, 1),
        ("dock ", 2, "", "Other", None, 2),
        ("DOCK", 3, None, "Other", None, 3),
        ("Cable", 5, "long", "Cables and Adapters", None, 4),
    ], INV)
    incoming = spark.createDataFrame([
        ("  dock", 4, None, "Tablets", 9.0, 1),          # three existing duplicates + one incoming
        ("New  Thing", 1, None, "Phones", None, 2),      # new key, twice
        ("new thing", 2, "", "Phones", 1.0, 3),
        ("   ", 1, None, "Phones", None, 4),             # blank name: rejected
        ("Cable", 1, "long", "Phones", -1.0, 5),         # negative price: rejected
    ], INC)
    out = upsert_items(existing, incoming)
    assert rows(out) == [
        ("Cable", 5, "long", "Cables and Adapters", None, 4),
        ("Dock", 10, None, "Laptop Accessories", 50.0, 1),
        ("New Thing", 3, None, "Phones", None, 5),
    ]


def test_upsert_after_append_without_ids(spark):
    from stockroom.operators import append_rows
    stock = spark.createDataFrame([("cable", 1, None, "S", None, 7), ("cable", 2, None, "S", None, 7),
                                   ("dock", 1, None, "S", None, 8)], INV)
    loose = spark.createDataFrame([("hub", 3), ("hub", 4), ("Dock", 5), ("fan", 6)], "Item string, Quantity long")
    incoming = spark.createDataFrame([("hub", 10, None, "S", None, 1), ("cable", 10, None, "S", None, 2),
                                      ("dock", 10, None, "S", None, 3), ("new", 1, None, "S", None, 4)], INC)
    out = upsert_items(append_rows(stock, loose), incoming)
    assert rows(out, "Item", "Quantity", "RowID") == [("cable", 13, 7), ("dock", 16, 8), ("fan", 6, None), ("hub", 17, None),
                                                      ("new", 1, 9)]


def test_upsert_null_quantity_makes_sum_null(spark):
    existing = spark.createDataFrame([("a", None, None, "S", None, 1)], INV)
    incoming = spark.createDataFrame([("a", 2, None, "S", None, 1)], INC)
    assert rows(upsert_items(existing, incoming), "Quantity") == [(None,)]


def _one_by_one(spark, existing, incoming_rows):
    cur = existing
    for r in incoming_rows:
        cur = spark.createDataFrame(upsert_items(cur, spark.createDataFrame([r], INC)).collect(), INV)
    return cur


def test_upsert_batch_equals_sequence(spark):
    rng = random.Random(7)
    names = ["usb", "USB ", "dock", "mouse", "pen"]
    existing_rows = [(rng.choice(names), rng.randint(1, 5), rng.choice([None, "", "x"]), "S", None, i + 1)
                     for i in range(8)]
    incoming_rows = [(rng.choice(names), rng.randint(1, 5), rng.choice([None, "", "x"]), "T", None, i + 1)
                     for i in range(6)]
    existing = spark.createDataFrame(existing_rows, INV)
    batch = upsert_items(existing, spark.createDataFrame(incoming_rows, INC))
    seq = _one_by_one(spark, existing, incoming_rows)
    # Same rows and quantities. Ids of appended rows are not compared: one at
    # a time, a merge can drop the row holding the highest id, so a later
    # "max + 1" is smaller than in the batch, which counts from the max of
    # the table it was given.
    cols = ["Item", "Quantity", "Comments", "Section", "Estimated Price"]
    assert rows(batch, *cols) == rows(seq, *cols)
    total_in = sum(r[1] for r in existing_rows) + sum(r[1] for r in incoming_rows)
    assert sum(r["Quantity"] for r in batch.collect()) == total_in
    new_ids = sorted(r["RowID"] for r in batch.collect() if r["RowID"] > 8)
    assert new_ids == list(range(9, 9 + len(new_ids)))


def test_append_and_collapse(spark):
    existing = spark.createDataFrame([("usb", 1, None, "Cables and Adapters", None, 1)], INV)
    incoming = spark.createDataFrame([(" usb ", 2, None, "Phones", None, 1), ("pen", None, "", "Phones", None, 2)], INC)
    out = append_and_collapse(existing, incoming)
    assert rows(out) == [("pen", "", 0, "Phones", "Phones & Accessories"),
                         ("usb", None, 3, "Cables and Adapters", "Cables & Adapters")]


def test_quantity_events_fixtures(spark):
    inv = spark.createDataFrame([("a", 1, None, "S", None, 1), ("b", 1, None, "S", None, 2),
                                 ("c", None, None, "S", None, 3), ("d", 2, None, "S", None, 4)], INV)
    ev = spark.createDataFrame([
        (1, 10, 1, -1), (2, 20, 1, 1),   # -1 then +1: row gone
        (3, 10, 2, 1), (4, 20, 2, -1),   # +1 then -1: stays at 1
        (5, 10, 3, -1),                  # null quantity stays null
        (6, 10, 99, -1),                 # unknown id ignored
    ], EV)
    out = apply_quantity_events(inv, ev)
    assert rows(out, "RowID", "Quantity") == [(2, 1), (3, None), (4, 2)]


def _brute_force(inv_rows, ev_rows):
    qty = {r[5]: r[1] for r in inv_rows}
    alive = set(qty)
    for _, _, rid, d in sorted(ev_rows, key=lambda e: (e[1], e[0])):
        if rid not in alive or qty[rid] is None:
            continue
        qty[rid] += d
        if d < 0 and qty[rid] <= 0:
            alive.discard(rid)
    return sorted((rid, qty[rid]) for rid in alive)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from([-1, 1]), st.integers(0, 50)), min_size=1, max_size=60),
       st.lists(st.integers(0, 4), min_size=3, max_size=3), st.integers(1, 6))
def test_quantity_events_match_brute_force_hot_key(spark, events, q0, parts):
    # Row 1 is the hot id: most events go to it; chunking must not change results.
    inv_rows = [(f"i{i}", q0[i - 1], None, "S", None, i) for i in (1, 2, 3)]
    ev_rows = [(k, ts, rid if k % 4 else 1, d) for k, (rid, d, ts) in enumerate(events)]
    inv = spark.createDataFrame(inv_rows, INV)
    ev = spark.createDataFrame(ev_rows, EV)
    out = apply_quantity_events(inv, ev, num_partitions=parts)
    assert rows(out, "RowID", "Quantity") == _brute_force(inv_rows, ev_rows)


def test_running_quantity_equals_window(spark):
    rng = random.Random(3)
    ev_rows = [(i, rng.randint(0, 30), 1 if rng.random() < 0.7 else rng.randint(2, 5), rng.choice([-1, 1]))
               for i in range(300)]
    ev = spark.createDataFrame(ev_rows, EV)
    w = Window.partitionBy("row_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    expected = ev.withColumn("running", F.sum("delta").over(w))
    for parts in (1, 4, 9):
        got = running_quantity(ev, num_partitions=parts)
        assert rows(got, "event_id", "running") == rows(expected, "event_id", "running")


def test_apply_buttons(spark):
    from stockroom.operators import apply_buttons
    inv = spark.createDataFrame([("a", 1, None, "S", None, 1), ("b", 2, None, "S", None, 2)], INV)
    clicks = spark.createDataFrame([(1, 10, "plus_2"), (2, 11, "minus_1"), (3, 12, "plus_1"), (4, 13, "noise"),
                                    (5, 14, "minus_2")], "event_id long, ts long, button string")
    assert rows(apply_buttons(inv, clicks), "RowID", "Quantity") == [(2, 2)]


def test_upsert_collapse_inner_option(spark):
    existing = spark.createDataFrame([("usb  cable", 1, None, "S", None, 1)], INV)
    incoming = spark.createDataFrame([("USB cable", 2, None, "S", None, 1)], INC)
    # Default: inner blanks are squished on the incoming side only, so the
    # existing "usb  cable" does not match and the item is appended.
    assert rows(upsert_items(existing, incoming), "Item", "Quantity", "RowID") == [
        ("USB cable", 2, 2), ("usb  cable", 1, 1)]
    # collapse_inner=True squishes both sides: one merged row.
    assert rows(upsert_items(existing, incoming, collapse_inner=True), "Item", "Quantity", "RowID") == [
        ("usb  cable", 3, 1)]
