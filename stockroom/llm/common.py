"""Helpers shared by the operators: lineage cuts, Arrow stages, components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.session import scratch_path

# Executors need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

# White space of the word rule: space, tab, line feed, vertical tab, form
# feed, carriage return (fixed values).
WORD_SPACES = " \t\n\x0b\x0c\r"
WORD_SPACES_CLASS = "[\\x20\\x09-\\x0D]+"

# Rows of an Arrow batch that are Python values at a time: whole texts can be
# long, so that they stay within tens of MB.
ARROW_ROWS = 500


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the cluster's shared scratch folder and read it back:
    the lineage is cut, and sizes are known to the planner, so joins on the
    result are broadcast when small and split by AQE when a key is hot."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
                schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function on a few rows at a time. Spark bounds its
    batches by bytes; no session setting is touched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ARROW_ROWS):
                yield from fn(batch.slice(k, ARROW_ROWS))

    return df.mapInArrow(run, schema)


def words(text):
    """Words of a text column as an array (null text: none), native."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACES_CLASS), "")


def labelled(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(doc_id, folds: int):
    """crc32 of the id's decimal text modulo ``folds`` (null id: -1, in no fold)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce one partition's edges to a spanning forest with small roots.
    Memory: one entry per node of the partition; flushed when large."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                           pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
        if len(parent) > 1_000_000:
            yield flush()
    yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; long), root
    being the smallest node reachable. Each partition first reduces its edges
    to a forest; then large-star and small-star rounds run until the edge set
    is a set of stars. Every round's minima are a written table, so that the
    join on a hot centre is split by AQE. No edges: no rows."""
    e = materialize(edges.where("a <> b").mapInArrow(_local_forest, "a long, b long"), "cc-forest")
    before = None
    while True:
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(sym.groupBy("a").agg(F.min("b").alias("m"))
                          .select("a", F.least("a", "m").alias("m")), "cc-low")
        large = (sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        e = materialize(large, "cc-large")
        low = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "cc-low2")
        small = (e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        e = materialize(small, "cc-small")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
