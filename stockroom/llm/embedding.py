"""Embedding near-duplicates by Euclidean p-stable hashing.

Equal vectors are one class, pre-aggregated before any shuffle. A class's
normalised vector falls into one bucket per table: the quantised values of
several Gaussian projections. Vectors sharing a bucket are compared exactly
in double precision, in blocks, so that a large bucket is many bounded units
of work; a pair counts only in the first table where it shares a bucket.
Units give degrees and a spanning forest, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import connected_components, map_batches, materialize

THRESHOLD = 0.9
SEED = 9
# Bucket width in multiples of the distance that the threshold allows.
WIDTH = 3.0
# Chance, at the threshold itself, that a pair shares a bucket; above it more.
RECALL = 0.985
BLOCK = 512


def _same_bucket(width: float) -> float:
    """Chance that one projection puts two points at distance 1 into one
    bucket of ``width`` (Gaussian projections)."""
    tail = 0.5 * math.erfc(width / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def table_shape(n: int) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` classes: buckets get finer
    as the data grow, and tables are added to hold the recall."""
    k = max(6, math.ceil(math.log2(max(n, 2)) / 2.5))
    hit = _same_bucket(WIDTH) ** k
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def unit_vector(values: list | None) -> np.ndarray | None:
    """Normalised double vector; None if null, zero or not finite."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def projections(dim: int, k: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, unit): node is a 64-bit digest of the vector, null if it links with nothing."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, units = [], []
        for values in batch.column(1).to_pylist():
            x = unit_vector(values)
            raw = None if x is None else (x + 0.0).tobytes()
            units.append(raw)
            nodes.append(None if raw is None else int.from_bytes(blake2b(raw, digest_size=8).digest(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())],
                                         ["vec_id", "node", "unit"])

    return map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run,
                       "vec_id long, node long, unit binary")


def _bucket_rows(classes: DataFrame, k: int, tables: int, threshold: float, seed: int) -> DataFrame:
    """Classes with ``codes``: the bucket of every table, 8 bytes each."""
    width = WIDTH * math.sqrt(2 - 2 * threshold)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        units = batch.column(2).to_pylist()
        codes = []
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for raw in units:
            x = np.frombuffer(raw)
            if len(x) not in made:
                made[len(x)] = projections(len(x), k, tables, width, seed)
            a, b = made[len(x)]
            q = np.floor((x @ a + b) / width).astype(np.int64).reshape(tables, k)
            codes.append(b"".join(blake2b(row.tobytes(), digest_size=8, key=len(x).to_bytes(4, "big")).digest() for row in q))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], ["node", "n", "unit", "codes"])

    return map_batches(classes.select("node", "n", "unit"), run, "node long, n long, unit binary, codes binary")


def _unit_links(rows: list[tuple], i: int, j: int, table: int, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Degrees (weighted by class sizes) and forest edges of one unit: the
    pairs of blocks i and j of a bucket. ``rows``: (node, n, unit, codes, block)."""
    x = np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), -1)
    block = np.array([r[4] for r in rows])
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return {}, []
    hit_l, hit_r = np.nonzero(x[left] @ x[right].T >= threshold)
    a, b = left[hit_l], right[hit_r]
    if i == j:
        a, b = a[a < b], b[a < b]
    if table and len(a):
        codes = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.int64).reshape(len(rows), -1)[:, :table]
        fresh = np.concatenate([~(codes[a[s:s + 65536]] == codes[b[s:s + 65536]]).any(axis=1) for s in range(0, len(a), 65536)])
        a, b = a[fresh], b[fresh]
    if not len(a):
        return {}, []
    n = np.array([r[1] for r in rows], dtype=np.int64)
    degree = np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
    parent = list(range(len(rows)))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    edges = []
    for u, v in zip(a.tolist(), b.tolist()):
        ru, rv = find(u), find(v)
        if ru != rv:
            parent[ru] = rv
            edges.append((rows[u][0], rows[v][0]))
    return {rows[v][0]: int(degree[v]) for v in np.flatnonzero(degree)}, edges


def _compare(units: DataFrame, threshold: float) -> DataFrame:
    """(node, other, degree) rows from units sorted within their partition:
    degree rows have no other, forest rows no degree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def solve() -> pa.RecordBatch | None:
            if key is None or len(held) < 2:
                return None
            degree, edges = _unit_links(held, key[2], key[3], key[0], threshold)
            if not degree:
                return None
            return pa.RecordBatch.from_arrays([
                pa.array([*degree, *(e[0] for e in edges)], pa.int64()),
                pa.array([None] * len(degree) + [e[1] for e in edges], pa.int64()),
                pa.array([*degree.values(), *[None] * len(edges)], pa.int64())], ["node", "other", "degree"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != key:
                    out = solve()
                    if out is not None:
                        yield out
                    key, held = row[:4], []
                held.append(row[4:])
        out = solve()
        if out is not None:
            yield out

    return units.mapInArrow(run, "node long, other long, degree long")


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links,
    component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing: no links, their own component, kept. Equal vectors
    link with each other. Vectors of different lengths never link. Repeated
    ids are separate vectors; a null id never names a component of others, and
    its row is kept only if it stands alone. Empty input gives no rows.
    """
    rows = materialize(_classes(vectors), "emb-rows")
    classes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("unit").alias("unit")), "emb-classes")
    k, tables = table_shape(classes.count())
    coded = materialize(_bucket_rows(classes, k, tables, threshold, seed), "emb-coded")
    spots = coded.select("node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("codes"), 8 * t + 1, F.lit(8)))).alias("t", "cell"))
    sizes = materialize(spots.groupBy("t", "cell").agg(F.count("*").alias("size")).where("size > 1"), "emb-cells")
    # Block b of a bucket's blocks meets every block, itself included.
    spots = spots.join(sizes, ["t", "cell"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    spots = spots.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    work = (spots.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("t", "cell", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "block"))
    placed = work.join(coded, "node").select("t", "cell", "i", "j", "node", "n", "unit", "codes", "block")
    placed = placed.repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j", "node")
    found = materialize(_compare(placed, threshold), "emb-found")
    degrees = found.where("degree is not null").groupBy("node").agg(F.sum("degree").alias("degree"))
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = materialize(classes.select("node", "n", "low").join(roots, "node", "left").join(degrees, "node", "left")
                         .select("node", F.coalesce("root", "node").alias("root"), "low",
                                 (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links")), "emb-linked")
    component = materialize(linked.groupBy("root").agg(F.min("low").alias("component_id")), "emb-components")
    by_node = materialize(linked.join(component, "root").select("node", "n_links", "component_id"), "emb-by-node")
    alone = F.col("n_links") == 0
    return (rows.select("vec_id", "node").join(by_node, "node", "left")
            .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
            .select("vec_id", "n_links", F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.when(F.col("n_links") == 0, F.lit(True)).otherwise(
                F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))))
