"""A key with a third of all rows must not become one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.operators import apply_quantity_events, first_per_key, running_quantity, with_chunks, with_row_id

from conftest import rows


def _hot_events(spark, n=3000):
    # Row id 7 gets every third event; the rest spread over 50 ids.
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") * 7 % 1000).alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50 + 100).alias("row_id"),
        F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.lit(1)).alias("delta"))


def test_hot_key_spans_many_chunks(spark):
    chunks = with_chunks(_hot_events(spark), ["row_id"], ["ts", "event_id"], num_partitions=8)
    per_chunk = {r["_chunk"]: r["n"] for r in
                 chunks.where(F.col("row_id") == 7).groupBy("_chunk").agg(F.count("*").alias("n")).collect()}
    assert len(per_chunk) >= 2
    assert max(per_chunk.values()) < 1000


def test_hot_key_running_and_events_exact(spark):
    ev = _hot_events(spark)
    w = Window.partitionBy("row_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    expected = ev.withColumn("running", F.sum("delta").over(w))
    got = running_quantity(ev, num_partitions=8)
    assert rows(got, "event_id", "running") == rows(expected, "event_id", "running")
    inv = spark.createDataFrame([(7, 1), (100, 0), (101, 5)], "RowID long, Quantity long")
    out = apply_quantity_events(inv, ev, num_partitions=8)
    floors = {r["row_id"]: r["floor"] for r in expected.groupBy("row_id").agg(
        F.min(F.when(F.col("delta") < 0, F.col("running"))).alias("floor")).collect()}
    nets = {r["row_id"]: r["net"] for r in ev.groupBy("row_id").agg(F.sum("delta").alias("net")).collect()}
    want = sorted((rid, q + nets.get(rid, 0)) for rid, q in [(7, 1), (100, 0), (101, 5)]
                  if floors.get(rid) is None or q + floors[rid] > 0)
    assert rows(out, "RowID", "Quantity") == want


def test_first_per_key_hot_key_is_partial_aggregate(spark):
    df = _hot_events(spark).select("row_id", "event_id", "ts")
    plan = first_per_key(df, ["row_id"], ["ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_row_id_hot_key_order(spark):
    df = _hot_events(spark).select("row_id", "event_id")
    out = with_row_id(df, ["row_id", "event_id"], name="rid", start=0, num_partitions=8)
    got = sorted((r["rid"], r["row_id"], r["event_id"]) for r in out.collect())
    assert [g[0] for g in got] == list(range(3000))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_upsert_with_a_hot_key(spark):
    """A third of all rows in one key on both sides; totals are kept."""
    from stockroom.operators import upsert_items
    n = 3000
    ex = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(" HOT ")).otherwise(F.concat(F.lit("i"), F.col("id"))).alias("Item"),
        F.lit(1).cast("bigint").alias("Quantity"), F.lit(None).cast("string").alias("Comments"),
        F.lit("S").alias("Section"), F.lit(1.0).alias("Estimated Price"), (F.col("id") + 1).alias("RowID"))
    inc = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id"))).alias("Item"),
        F.lit(1).cast("bigint").alias("Quantity"), F.lit("").alias("Comments"), F.lit("S").alias("Section"),
        F.lit(1.0).alias("Estimated Price"), F.col("id").alias("seq"))
    out = upsert_items(ex, inc)
    hot = out.where("trim(lower(Item)) = 'hot'").collect()
    assert [(r["Item"], r["Quantity"], r["RowID"]) for r in hot] == [(" HOT ", 2000, 1)]
    assert out.count() == 1 + 2000 + 2000 and out.agg(F.sum("Quantity")).first()[0] == 2 * n
    assert out.select("RowID").distinct().count() == out.count()
