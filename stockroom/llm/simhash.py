"""SimHash near-duplicates: segment-popcount embedding with a grid join.

A 64-bit fingerprint is mapped to the vector of its per-segment bit counts
(segments of two bits). The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints. The embedding is held as
one long in unary code per segment (00, 01, 11), so that the Manhattan
distance is the bit count of an xor. The axes are dealt into ``GROUPS``
groups; two vectors within distance 3 agree in all but three groups at
most, so they share a grid cell of one of the C(6, 3) = 20 projections on
three groups. Cells are joined on equality, filtered by the Manhattan bound,
then verified by the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import connected_components, map_batches, materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
GROUPS = 6
_SLICE = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of one text; no word (or null): zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _SLICE):
        part = words[lo:min(n, lo + _SLICE) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """All columns of ``docs`` but the text, and ``fp`` (long). Null and empty
    texts get fingerprint zero."""
    keep = [c for c in docs.columns if c != text]
    sel = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    out = sel.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = pa.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*keep, "fp"])

    return map_batches(sel, run, out)


def _group_masks(groups: int) -> list[int]:
    """Bit masks of ``groups`` runs of whole two-bit segments over 64 bits."""
    cuts = [2 * round(32 * g / groups) for g in range(groups + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def projection_masks(groups: int = GROUPS, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of all choices of ``groups - max_bits`` axis groups."""
    g = _group_masks(groups)
    return [_signed(sum(c)) for c in combinations(g, groups - max_bits)]


def popcount_embedding(fp):
    """Per-segment bit counts in unary code: each two-bit segment sorted."""
    low = F.lit(_signed(0x5555555555555555))
    hi = F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(hi).bitwiseAND(low)
    both = fp.bitwiseAND(hi).bitwiseAND(low)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """Pairs (a < b) of different fingerprints within ``max_bits``, each once.
    ``fps`` holds distinct fingerprints in column fp."""
    if groups <= max_bits:
        raise ValueError("groups must exceed max_bits")
    masks = projection_masks(groups, max_bits)
    cells = (fps.select("fp", popcount_embedding(F.col("fp")).alias("e"))
             .select("fp", "e", F.posexplode(F.array(*[F.lit(m).bitwiseAND(F.col("e")) for m in masks])).alias("p", "cell")))
    a, b = cells.alias("a"), cells.alias("b")
    diff = F.col("a.e").bitwiseXOR(F.col("b.e"))
    first = F.lit(len(masks))
    for k in range(len(masks) - 1, -1, -1):
        first = F.when(diff.bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(first)
    return (a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.cell") == F.col("b.cell"))
                   & (F.col("a.fp") < F.col("b.fp"))
                   & (F.bit_count(diff) <= max_bits)
                   & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
                   & (first == F.col("a.p")))
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                       max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """One row per input row: (doc_id, fp, root, component_id); root is the
    component's smallest fingerprint.

    Rows of equal fingerprint are one class, pre-aggregated before any
    shuffle; links are searched between distinct fingerprints only, and none
    is dropped. component_id is the smallest non-null id of the component
    (null if it has none). Null texts count as empty: fingerprint zero, linked
    like any other. Repeated rows and ids stay as they are. Empty input gives
    no rows.
    """
    fp = materialize(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                                  "text", shingle), "simhash-fp")
    classes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), max_bits, groups))
    rooted = materialize(classes.join(roots, classes.fp == roots.node, "left")
                         .select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    component = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-components")
    by_fp = materialize(rooted.join(component, "root").select("fp", "root", "component_id"), "simhash-by-fp")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                           groups: int = GROUPS) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate component, all columns
    kept: the row of the smallest id. Rows that the id cannot tell apart
    (repeated ids, null ids) are told apart by fingerprint and text: of those
    holding a component's smallest id, the one with the smallest fingerprint
    and text stays, once. Null ids come after all others."""
    comp = materialize(simhash_components(docs, shingle=shingle, max_bits=max_bits, groups=groups), "simhash-rows")
    ids = materialize(comp.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("wins"))
        .where("n > 1 or doc_id is null or not wins"), "simhash-ids")
    clear = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    unclear = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    if unclear.isEmpty():
        return clear
    rows = (docs.join(unclear, docs.doc_id.eqNullSafe(unclear["__id"]), "left_semi")
            .select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("__copy")))
    roots = comp.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "root").distinct()
    held = fingerprints(rows, "__copy", shingle)
    joined = held.join(roots, (held.fp == roots["__fp"]) & held["row.doc_id"].eqNullSafe(roots["__id"]))
    best = joined.groupBy("root").agg(F.min_by("row", F.struct("fp", F.col("row.text"))).alias("row")).select("row.*")
    return clear.unionByName(best)
