"""Deep pages and text search over written indexes.

``table_page`` sorts and scans per request. A table that is paged or searched
often is laid out once: in ranges of its sort order with their row counts, so
that any page reads the ranges that hold it, and with the n-grams of its
texts, so that a search reads the rows that can match.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import default_parallelism
from .ordering import _orderable, search_filter

GRAM = 3
# Folders of grams: a search reads those of its own grams.
GRAM_BUCKETS = 64


def _order(sort: Sequence[tuple[str, bool]]) -> list[Column]:
    return [(F.asc_nulls_last if asc else F.desc_nulls_last)(F.col(f"`{c}`")) for c, asc in sort]


@dataclass(frozen=True)
class PagedTable:
    """A table written in ranges of its sort order: ``rows/_range=<r>`` in
    order, and ``counts`` (_range, n, before)."""

    spark: SparkSession
    root: str
    sort: tuple[tuple[str, bool], ...]

    def page(self, page: int = 0, size: int = 10) -> DataFrame:
        """One page: reads only the ranges that hold it."""
        first = page * size
        held = (self.spark.read.parquet(f"{self.root}/counts")
                .where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).orderBy("before").collect())
        rows = self.spark.read.parquet(f"{self.root}/rows")
        view = rows.where(F.col("_range").isin([r["_range"] for r in held])).orderBy(*_order(self.sort), *self._ties(rows))
        return view.offset(first - held[0]["before"] if held else 0).limit(size).drop("_range")

    def _ties(self, rows: DataFrame) -> list[Column]:
        return _orderable(rows, ["_range", *[c for c, _ in self.sort]])

    def count(self) -> int:
        return self.spark.read.parquet(f"{self.root}/counts").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_paged(df: DataFrame, root: str, sort: Sequence[tuple[str, bool]], num_ranges: int | None = None) -> PagedTable:
    """Lay a table out for pages in ``sort`` order (S4); remaining columns
    break ties, so that pages never overlap. One range shuffle, once; the
    counts (one row per range) are put in order."""
    spark = df.sparkSession
    out = PagedTable(spark, root.rstrip("/"), tuple(sort))
    order = [*_order(sort), *out._ties(df)]
    (df.repartitionByRange(num_ranges or default_parallelism(spark), *order).withColumn("_range", F.spark_partition_id())
     .sortWithinPartitions("_range", *order).write.partitionBy("_range").parquet(f"{out.root}/rows"))
    counts = spark.read.schema(_with_range(df)).parquet(f"{out.root}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{out.root}/counts")
    return out


def _with_range(df: DataFrame):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([*df.schema.fields, StructField("_range", IntegerType())])


def _grams(text: Column) -> Column:
    """Distinct grams of a lower-case text; a text shorter than a gram is one."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1))), lambda p: F.substring(text, p, F.lit(GRAM)))
    return F.array_distinct(F.when(n > 0, cut).otherwise(F.array().cast("array<string>")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def write_gram_index(df: DataFrame, root: str, id_col: str) -> None:
    """(gram, row id) of the lower-case texts of all columns, in folders by
    the gram's hash, sorted by gram: file statistics skip the rest.
    ``id_col`` tells rows apart; rows of one id each write their grams.

    A row's grams are made distinct in the row, and short rows are dealt out
    before they become many grams each, so that no task holds the grams of a
    large file. The grams are sorted in parts that Spark cuts to size."""
    texts = F.array(*[F.lower(F.col(f"`{c}`").cast("string")) for c in df.columns])
    rows = (df.select(F.col(f"`{id_col}`").alias("row_id"), texts.alias("texts"))
            .repartition(default_parallelism(df.sparkSession), "row_id", "texts"))
    of_row = F.array_distinct(F.flatten(F.transform("texts", _grams)))
    grams = (rows.select("row_id", F.explode(of_row).alias("gram")).withColumn("_bucket", _bucket(F.col("gram")))
             .withColumn("_slice", F.pmod(F.xxhash64("row_id"), F.lit(8))))
    (grams.hint("rebalance", F.col("_bucket"), F.col("_slice")).drop("_slice")
     .sortWithinPartitions("_bucket", "gram").write.partitionBy("_bucket").parquet(root))


def search_indexed(df: DataFrame, root: str, id_col: str, search: str | None) -> DataFrame:
    """The rows of ``search_filter``, found through the gram index: rows that
    hold every gram of the search text (or, for one shorter than a gram, any gram
    that contains it), checked exactly."""
    if not search:
        return df
    spark = df.sparkSession
    s = search.lower()
    index = spark.read.parquet(root)
    if len(s) < GRAM:
        found = index.where(F.col("gram").contains(s)).select("row_id").distinct()
    else:
        wanted = sorted({s[k:k + GRAM] for k in range(len(s) - GRAM + 1)})
        buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "g string").select(_bucket(F.col("g"))).distinct().collect()]
        found = (index.where(F.col("_bucket").isin(buckets) & F.col("gram").isin(wanted)).groupBy("row_id")
                 .agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("row_id"))
    rows = df.join(found, df[f"`{id_col}`"].eqNullSafe(found["row_id"]), "left_semi")
    return search_filter(rows, search)
