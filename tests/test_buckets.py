"""An upsert into a bucketed table equals the upsert of the whole table, and writes few buckets."""

import os

from pyspark.sql import functions as F

from stockroom.operators import upsert_items
from stockroom.sources.buckets import BucketedItems

from conftest import rows


def _items(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("Item "), F.col("id")).alias("Item"), (F.col("id") % 9).alias("Quantity"),
        F.when(F.col("id") % 2 == 0, F.lit("note")).alias("Comments"), F.lit("S").alias("Section"),
        F.lit(1.5).alias("Estimated Price"), (F.col("id") + 1).alias("RowID"))


def test_a_small_batch_writes_few_buckets(spark, tmp_dir):
    existing = _items(spark, 1000)
    table = BucketedItems(spark, f"{tmp_dir}/t", existing.schema, 200)
    table.write(existing)
    assert rows(table.read()) == rows(existing) and len(table.newest()) > 150
    incoming = _items(spark, 10).select(F.concat(F.lit("  "), F.upper("Item")).alias("Item"), F.lit(5).cast("long").alias("Quantity"),
                                        "Comments", "Section", "Estimated Price", F.col("RowID").alias("seq"))
    incoming = incoming.unionByName(spark.createDataFrame([("brand new", 2, None, "S", 2.0, 90), (" ", 1, None, "S", 2.0, 91)],
                                                          incoming.schema))
    rejected = table.upsert(incoming)
    assert rejected.count() == 1
    want = upsert_items(existing, incoming)
    assert rows(table.read()) == rows(want)
    assert table.read().where("Item = 'brand new'").first().RowID == 1001
    written = [f for f in os.listdir(f"{tmp_dir}/t/rows/seq=1") if f.startswith("_kb=")]
    assert 1 <= len(written) <= 11
    second = incoming.where("Item = 'brand new'")
    table.upsert(second)
    assert rows(table.read()) == rows(upsert_items(want, second))
    before = rows(table.read())
    assert table.prune() >= len(written) - 1  # a bucket that only the new item has may be new
    assert table.prune() == 0
    assert rows(table.read()) == before


def test_a_write_that_died_and_a_batch_without_accepted_rows(spark, tmp_dir):
    existing = _items(spark, 50)
    table = BucketedItems(spark, f"{tmp_dir}/t", existing.schema, 8)
    assert table.read().count() == 0
    table.write(existing)
    os.makedirs(f"{tmp_dir}/t/rows/seq=1/_kb=0")
    assert rows(table.read()) == rows(existing)
    none = spark.createDataFrame([("  ", 1, None, "S", 2.0, 1)], "Item string, Quantity long, Comments string, Section string, `Estimated Price` double, seq long")
    assert table.upsert(none).count() == 1 and table.writes() == [0]
    table.upsert(none.withColumn("Item", F.lit("x")))
    assert table.writes() == [0, 2] and table.read().count() == 51
