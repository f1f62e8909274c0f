"""An inventory laid out by a bucket of its match key.

Rows of one match key are in one bucket, so an upsert reads and writes only
the buckets that its batch touches. ``rows/seq=<K>/_kb=<B>`` holds bucket B as
the K-th write left it; the newest complete write of a bucket counts. Folders
are plain Parquet, never replaced: a write that died is passed over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.changes import prepare_incoming, upsert_with_rejects
from ..operators.joins import _with_match_keys
from .sinks import _fs, delete_path

_BUCKET = "_kb"


def _children(spark: SparkSession, path: str, prefix: str, complete: bool) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [st.getPath() for st in fs.listStatus(p) if st.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(f.getName().split("=")[1]) for f in found if not complete or fs.exists(jpath(f, "_SUCCESS")))


@dataclass(frozen=True)
class BucketedItems:
    """A table in ``buckets`` buckets of the match key of ``keys``. Choose the
    number so that a bucket is a few hundred MB; one writer at a time."""

    spark: SparkSession
    root: str
    schema: StructType
    buckets: int
    keys: tuple[str, ...] = ("Item", "Comments")
    collapse_inner: bool = False

    def _bucketed(self, df: DataFrame) -> DataFrame:
        keyed, names = _with_match_keys(df, list(self.keys), self.collapse_inner)
        bucket = F.pmod(F.xxhash64(*names), F.lit(self.buckets)).cast("int")
        return keyed.withColumn(_BUCKET, bucket).select(*[F.col(f"`{c}`") for c in df.columns], _BUCKET)

    def writes(self) -> list[int]:
        return _children(self.spark, f"{self.root}/rows", "seq", True)

    def newest(self) -> dict[int, int]:
        """Bucket -> the newest write that holds it; at most one entry per bucket."""
        return {b: k for k in self.writes() for b in _children(self.spark, f"{self.root}/rows/seq={k}", _BUCKET, False)}

    def _write(self, rows: DataFrame) -> int:
        held = _children(self.spark, f"{self.root}/rows", "seq", False)
        seq = held[-1] + 1 if held else 0
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/rows/seq={seq}")
        return seq

    def write(self, df: DataFrame) -> int:
        """The whole table, every bucket."""
        return self._write(self._bucketed(df.select([F.col(f"`{c}`") for c in self.schema.fieldNames()])))

    def _read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        newest = self.newest()
        paths = [f"{self.root}/rows/seq={k}/{_BUCKET}={b}" for b, k in sorted(newest.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read()

    def upsert(self, incoming: DataFrame, order_col: str = "RowID", **options) -> DataFrame:
        """Merge a batch (I1); returns its rejected rows. Only the buckets that
        the batch touches are read and written; of the others, the ids are read
        for the next id."""
        whole = self.read()
        names = {k: v for k, v in options.items() if k in ("price_col", "section_col", "groups")}
        accepted, _ = prepare_incoming(whole, incoming, keys=self.keys, **names)
        touched = [r[0] for r in self._bucketed(accepted.select(*self.keys)).select(_BUCKET).distinct().collect()]
        merged, rejected = upsert_with_rejects(self._read(touched), incoming, order_col, keys=self.keys,
                                               collapse_inner=self.collapse_inner, id_table=whole, **options)
        if touched:
            self._write(self._bucketed(merged))
        return rejected

    def prune(self) -> int:
        """Delete bucket folders that a newer write replaced; returns their number."""
        newest, gone = self.newest(), 0
        for k in self.writes():
            for b in _children(self.spark, f"{self.root}/rows/seq={k}", _BUCKET, False):
                if newest[b] != k:
                    delete_path(self.spark, f"{self.root}/rows/seq={k}/{_BUCKET}={b}")
                    gone += 1
        return gone
