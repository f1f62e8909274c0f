"""Pages and searches through indexes equal those by sorting and scanning."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from stockroom.operators import search_filter, table_page
from stockroom.operators.paging import search_indexed, write_gram_index, write_paged

from conftest import rows


def test_a_deep_page_reads_its_range_only(spark, tmp_dir):
    n = 200_000
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("price"), F.lit("x").alias("note"))
    sort = [("price", False), ("id", True)]
    table = write_paged(df, f"{tmp_dir}/t", sort, 16)
    assert table.count() == n
    for page, size in ((0, 10), (10_000, 10), (19_999, 10), (20_000, 10), (3, 7), (1, 30_000)):
        assert table.page(page, size).collect() == table_page(df, sort=sort, page=page, size=size).collect()
    deep = table.page(19_000, 10)
    deep.collect()
    plan = deep._jdf.queryExecution().executedPlan().toString()
    read = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert re.search(r"_range#\d+ (= \d+|IN \(\d+,\d+\))", read), read


def test_pages_with_ties_nulls_and_an_empty_table(spark, tmp_dir):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "a"), (None, "b"), (2, None)], "k int, v string")
    table = write_paged(df, f"{tmp_dir}/t", [("k", True)], 3)
    got = [tuple(r) for p in range(4) for r in table.page(p, 2).collect()]
    assert got == [(1, "a"), (1, "b"), (2, None), (None, "a"), (None, "b")]
    empty = write_paged(df.limit(0), f"{tmp_dir}/e", [("k", True)], 3)
    assert empty.count() == 0


@pytest.mark.parametrize("needle", ["plate", "PLA", "te", "x", "", "zzz", "é", "a b", "12", "ab"])
def test_search_by_grams_equals_the_scan(spark, tmp_dir, needle):
    data = [(k, t, k * 37 % 1000, None if k % 3 else "Steel Plate") for k, t in enumerate(
        ["Plates", "a b", "ab", "x", "", None, "café", "ÉTÉ", "template 12", "pl ate", "late", "plaplate", "A  B"])]
    df = spark.createDataFrame(data, "id long, name string, n long, note string")
    write_gram_index(df, f"{tmp_dir}/g", "id")
    assert rows(search_indexed(df, f"{tmp_dir}/g", "id", needle)) == rows(search_filter(df, needle))


def test_the_gram_index_holds_no_grams_of_a_file_in_a_task(spark, tmp_dir, monkeypatch):
    spark.range(300).select("id", F.concat(F.lit("steel plate "), F.col("id")).alias("name")).coalesce(1).write.parquet(f"{tmp_dir}/t")
    plans, parquet = [], DataFrameWriter.parquet

    def noted(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    write_gram_index(spark.read.parquet(f"{tmp_dir}/t"), f"{tmp_dir}/g", "id")
    (plan,) = plans
    # No hash table of (gram, row id); the rows leave the file's tasks before they become grams.
    assert "Aggregate" not in plan, plan
    assert "Exchange" in plan.split("Generate")[-1], plan


def test_search_by_grams_with_repeated_and_null_ids(spark, tmp_dir):
    data = [(1, "Plate", None), (1, "plates", "plate"), (1, "plat", "late"), (1, "pla", None), (2, "late", None), (2, "pla", None),
            (None, "PLATE", None), (None, "plate", "plate"), (None, None, None), (3, "", "x"), (4, "a plate", None), (4, "a plate", None)]
    df = spark.createDataFrame(data, "id long, name string, note string")
    write_gram_index(df, f"{tmp_dir}/g", "id")
    for needle in ("plate", "late", "pl", "pla", "zzz"):
        assert rows(search_indexed(df, f"{tmp_dir}/g", "id", needle)) == rows(search_filter(df, needle)), needle
