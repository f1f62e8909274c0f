"""Plans that must hold at any size: one exchange of events, no sorted wide rows."""

import re

import pytest
from pyspark.sql import functions as F

from stockroom.operators import (append_and_collapse, collapse_exact, collapse_items, first_per_key, running_quantity,
                                 with_buckets)
from stockroom.operators.changes import net_and_floor
from stockroom.sources import flatten_sections


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark):
    return spark.range(4000).select(
        F.col("id").alias("event_id"), (F.col("id") * 7 % 1000).alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50 + 100).alias("row_id"),
        F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.lit(1)).alias("delta"))


def test_a_hot_key_is_cut_into_buckets_of_its_order(spark):
    rows = with_buckets(_events(spark), ["row_id"], ["ts", "event_id"], 8)
    sizes = [r["count"] for r in rows.where("row_id = 7").groupBy("_bucket").count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 1000
    assert rows.where("row_id <> 7").agg(F.max("_bucket")).first()[0] == 0
    mixed = rows.where("row_id = 7").groupBy("_bucket").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b"))
    ends = [(r._bucket, r.a, r.b) for r in mixed.orderBy("_bucket").collect()]
    assert all(x[2] < y[1] for x, y in zip(ends, ends[1:]))


def test_events_are_exchanged_once(spark, no_broadcast):
    """Exchanges that carry the order columns: the one by (id, bucket)."""
    for df in (running_quantity(_events(spark)), net_and_floor(_events(spark))):
        lines = _plan(df).splitlines()
        # An exchange of partial sums is narrow; the others move events.
        wide = [a for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning(" in a and "Aggregate" not in b]
        assert len(wide) == 1, _plan(df)
        assert "rangepartitioning" not in _plan(df)


def test_sheets_are_exchanged_once(spark, no_broadcast):
    sheet = spark.range(5000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("S"), F.col("id"))).otherwise(F.lit("x")).alias("Item"),
                                     F.when(F.col("id") % 100 != 0, F.col("id")).alias("Quantity"), F.col("id").alias("pos"))
    out = flatten_sections(sheet, "pos")
    assert _plan(out).count("Exchange hashpartitioning(_g0") <= 3 and "rangepartitioning" not in _plan(out)
    assert out.where(F.col("Section") != F.concat(F.lit("S"), F.floor(F.col("pos") / 100) * 100)).count() == 0


def test_first_rows_sort_nothing_wide(spark, no_broadcast):
    df = spark.range(500).select((F.col("id") % 20).cast("string").alias("Item"), F.lit(None).cast("string").alias("Comments"),
                                 F.col("id").alias("Quantity"), F.lit("s").alias("Section"), F.repeat(F.lit("wide"), 50).alias("Note"),
                                 (1000 - F.col("id")).alias("RowID"), F.col("id").alias("seq"))
    for out in (collapse_exact(df, "RowID", carry=["Section", "Note"]), collapse_items(df), first_per_key(df, ["Item"], ["RowID"]),
                append_and_collapse(df.drop("seq"), df.drop("RowID"))):
        assert "SortAggregate" not in _plan(out) and "ObjectHashAggregate" not in _plan(out)
    assert {r.RowID for r in first_per_key(df, ["Item"], ["RowID"]).collect()} == set(range(501, 521))


def test_first_rows_with_null_and_tied_orders(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 3), ("b", None, 4), ("b", None, 5), (None, -3, 6), (None, 2, 7)],
                               "k string, o long, v int").coalesce(1)
    assert {r.k: r.v for r in first_per_key(df, ["k"], ["o"]).collect()} == {"a": 2, "b": 4, None: 6}
    typed = df.select("k", "v", F.timestamp_seconds("o").alias("t"), F.date_from_unix_date(F.col("o").cast("int")).alias("d"), F.col("o").cast("string").alias("s"))
    for c in ("t", "d"):
        assert {r.k: r.v for r in first_per_key(typed, ["k"], [c]).collect()} == {"a": 2, "b": 4, None: 6}
    assert {r.k: r.v for r in first_per_key(typed, ["k"], ["s"]).collect()} == {"a": 2, "b": 4, None: 6}
    big = spark.createDataFrame([("a", 2 ** 62, 1), ("a", -2 ** 62, 2), ("a", -2 ** 63 + 1, 3)], "k string, o long, v int")
    assert first_per_key(big, ["k"], ["o"]).first().v == 3


def test_rows_without_an_id_keep_a_running_sum(spark):
    ev = spark.createDataFrame([(1, 1, None, 1), (2, 2, None, -1), (3, 1, 5, 4)], "event_id long, ts long, row_id long, delta long")
    assert sorted((r.event_id, r.running) for r in running_quantity(ev).collect()) == [(1, 1), (2, 0), (3, 4)]
    assert re.search("Window", _plan(running_quantity(ev)))
