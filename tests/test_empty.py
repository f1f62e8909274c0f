"""Operators on empty inputs: no rows in, the right (possibly empty) rows out."""

from stockroom.operators import (apply_quantity_events, collapse_items, first_per_key, group_total,
                                 running_quantity, share_of_total, summary_totals, upsert_items, with_row_id)
from stockroom.sources import flatten_sections

from conftest import rows

INV = "Item string, Quantity long, Comments string, Section string, `Estimated Price` double, RowID long"
INC = "Item string, Quantity long, Comments string, Section string, `Estimated Price` double, seq long"
EV = "event_id long, ts long, row_id long, delta int"


def test_upsert_with_empty_sides(spark):
    existing = spark.createDataFrame([("a", 1, None, "S", None, 1)], INV)
    assert rows(upsert_items(existing, spark.createDataFrame([], INC))) == [("a", 1, None, "S", None, 1)]
    new = upsert_items(spark.createDataFrame([], INV), spark.createDataFrame([("b", 2, None, "S", 1.0, 7)], INC))
    assert rows(new) == [("b", 2, None, "S", 1.0, 1)]


def test_events_empty(spark):
    inv = spark.createDataFrame([("a", 1, None, "S", None, 1)], INV)
    none = spark.createDataFrame([], EV)
    assert rows(apply_quantity_events(inv, none)) == [("a", 1, None, "S", None, 1)]
    assert running_quantity(none).count() == 0


def test_row_ids_and_first_rows_on_empty(spark):
    empty = spark.createDataFrame([], "k long, v string")
    assert with_row_id(empty, ["k"]).count() == 0
    assert first_per_key(empty, ["k"], ["v"]).count() == 0
    assert collapse_items(spark.createDataFrame([], INV)).count() == 0


def test_aggregates_on_empty(spark):
    empty = spark.createDataFrame([], "k string, v double")
    g = group_total(empty, "k", "v")
    assert g.count() == 0 and share_of_total(g, "total").count() == 0
    assert summary_totals({"A": (empty, "v")}).count() == 0


def test_flatten_without_dividers(spark):
    df = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "Item string, Quantity long, pos long")
    assert rows(flatten_sections(df, "pos"), "Item", "Section") == [("x", None), ("y", None)]
