"""Ranked lexical search with hashed max-sketches.

A document's impact of a term is its share of the score that depends on the
document alone; the query's weight of the term is the other factor. Each
document's impacts are folded into a sketch: every term is hashed to a
few coordinates, each of which keeps the greatest impact of its terms. A query
looks up the least coordinate of each of its terms; the weighted sum bounds the
score from above, as a coordinate is never below the impact of a term folded into it.

Queries are looked up in batches: all sketches of a slice of documents
against all queries of a block. Documents are then scored exactly, in
descending order of their bounds, until a bound falls below the query's
tenth score so far, which a task carries from slice to slice. Every task
returns its ten best rows per query, and those are ranked.

Statistics (documents, terms, document frequencies of the queries' terms)
cover all documents. The query set is cut into blocks of bounded size, which
travel with the job; documents never leave their tasks.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stockroom.llm.common import materialize
from stockroom.llm.slices import WordHashes, folded_words, map_texts, text_slices

TOP = 10
# Coordinates of a term (the least of their values counts), and of a sketch per distinct term.
FOLDS = 2
SPREAD = 16
_FOLD_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)
# (query, term) pairs of one block of queries: bounds what is sent with a job.
BLOCK_PAIRS = 200_000
# Distinct terms that a task counts before it passes them on.
_COUNTED = 400_000
# Values of one lookup (pairs x documents).
_LOOKUP = 1 << 21
_TOTALS = ""  # no term is empty: the row that counts documents and all terms


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that df of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    """Relative length of a document of n terms."""
    return 100 - 90 + (90 * n * n_docs) // n_terms


def query_terms(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows of one id are one item."""
    def cut(texts: list[bytes], _: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([[t.decode("utf-8", "replace") for t in sorted(set(folded_words(x)))] for x in texts], pa.list_(pa.string()))]

    table = map_texts(items.select("text", F.col(f"`{item_id}`").alias("item_id")), ["item_id"], cut,
                      [T.StructField("terms", T.ArrayType(T.StringType()))])
    return table.select("item_id", F.explode("terms").alias("term")).distinct()


def term_statistics(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, n) of the given terms over all documents; the row of the
    empty term has the documents with a term and the number of all terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        some = total = 0

        def rows() -> pa.RecordBatch:
            names = [_TOTALS, *(t.decode("utf-8", "replace") for t in held)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([some, *held.values()], pa.int64()),
                                               pa.array([total] + [0] * len(held), pa.int64())], ["term", "df", "n"])

        for texts, _ in text_slices(batches):
            for raw in texts:
                words = folded_words(raw)
                held.update(set(words))
                some += bool(words)
                total += len(words)
            if len(held) > _COUNTED:
                yield rows()
                held.clear()
                some = total = 0
        yield rows()

    wanted = terms.select("term").union(terms.sparkSession.createDataFrame([(_TOTALS,)], "term string")).distinct()
    return (docs.select("text").mapInArrow(count, "term string, df long, n long").join(wanted, "term", "left_semi")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")))


class QueryBlock:
    """A bounded block of queries: their terms' hashes and weights in one
    run per query."""

    def __init__(self, rows: list[tuple], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        pairs: dict = {}
        for item, term, df in rows:
            pairs.setdefault(item, []).append((term.encode(), weight(n_docs, df)))
        self.items = sorted(pairs, key=lambda x: (x is None, x))
        self.terms = [sorted(pairs[i]) for i in self.items]
        sizes = [len(t) for t in self.terms]
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = WordHashes().of([t for own in self.terms for t, _ in own])
        self.weights = np.array([w for own in self.terms for _, w in own], dtype=np.int64)

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bound of every query's score for every sketch (a column each)."""
        width, n = sketches.shape
        out = np.empty((len(self.items), n), dtype=np.int64)
        step = max(1, _LOOKUP // n)
        first = 0
        while first < len(self.items):
            last = max(first + 1, int(np.searchsorted(self.begin, self.begin[first] + step, side="right")) - 1)
            a, b = self.begin[first], self.begin[last]
            met = sketches[_coordinate(self.hashes[a:b], 0, width)]
            for k in range(1, FOLDS):
                np.minimum(met, sketches[_coordinate(self.hashes[a:b], k, width)], out=met)
            met *= self.weights[a:b, None]
            out[first:last] = np.add.reduceat(met, self.begin[first:last] - a, axis=0)
            first = last
        return out

    def score(self, query: int, counts: Counter, factor: int) -> int:
        """The exact score of a document."""
        total = 0
        for term, w in self.terms[query]:
            tf = counts.get(term)
            if tf:
                total += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * factor))
        return total


def _coordinate(hashes: np.ndarray, fold: int, width: int) -> np.ndarray:
    """Coordinate of terms in one of the folds of a sketch of ``width``."""
    return ((hashes * np.uint64(_FOLD_FACTORS[fold])) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def sketches(counts: list[Counter], factors: list[int], hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, their sketches as columns) by width: the power of two that
    is at least SPREAD times the number of a document's terms."""
    widths = np.array([1 << (SPREAD * max(1, len(c)) - 1).bit_length() for c in counts], dtype=np.int64)
    for width in np.unique(widths[[bool(c) for c in counts]]).tolist():
        docs = np.array([d for d in np.flatnonzero(widths == width).tolist() if counts[d]], dtype=np.int64)
        for lo in range(0, len(docs), max(1, _LOOKUP // width)):
            some = docs[lo:lo + max(1, _LOOKUP // width)]
            size = [len(counts[d]) for d in some]
            term = np.concatenate([hashes.of(counts[d].keys()) for d in some])
            tf = np.concatenate([np.fromiter(counts[d].values(), dtype=np.int64, count=n) for d, n in zip(some, size)])
            factor = np.repeat(np.array([factors[d] for d in some], dtype=np.int64), size)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * factor)
            column = np.repeat(np.arange(len(some)), size)
            sketch = np.zeros((width, len(some)), dtype=np.int64)
            for k in range(FOLDS):
                np.maximum.at(sketch.reshape(-1), _coordinate(term, k, width) * len(some) + column, impact)
            yield some, sketch


class Best:
    """The best rows of every query of a block so far."""

    def __init__(self, block: QueryBlock, top: int):
        self.block, self.top = block, top
        self.held: list[list[tuple]] = [[] for _ in block.items]  # (-score, no id, id)
        self.least = np.ones(len(block.items), dtype=np.int64)

    def take(self, ids: list, counts: list[Counter], hashes: WordHashes) -> None:
        """Documents by descending bound, until no bound reaches the last place."""
        block = self.block
        factors = [length_factor(c.total(), block.n_docs, block.n_terms) for c in counts]
        for docs, sketch in sketches(counts, factors, hashes):
            bounds = block.bounds(sketch)
            for q in np.flatnonzero((bounds >= self.least[:, None]).any(axis=1)).tolist():
                reach = np.flatnonzero(bounds[q] >= self.least[q])
                for k in reach[np.argsort(-bounds[q, reach], kind="stable")].tolist():
                    if bounds[q, k] < self.least[q]:
                        break
                    d = int(docs[k])
                    score = block.score(q, counts[d], factors[d])
                    if score >= self.least[q]:
                        self._place(q, score, ids[d])

    def _place(self, q: int, score: int, doc_id) -> None:
        held = self.held[q]
        insort(held, (-score, doc_id is None, doc_id))
        del held[self.top:]
        if len(held) == self.top:
            self.least[q] = -held[-1][0]  # an equal score may still win by its id


def _search(docs: DataFrame, block: QueryBlock, top: int, item_type: T.DataType) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType
    kinds = [to_arrow_type(item_type), to_arrow_type(id_type), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hashes = Best(block, top), WordHashes()
        for texts, others in text_slices(batches):
            best.take(others[0].to_pylist(), [Counter(folded_words(t)) for t in texts], hashes)
        rows = [(item, doc, -score) for item, held in zip(block.items, best.held) for score, _, doc in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                         ["item_id", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return docs.select("text", "doc_id").mapInArrow(run, schema)


def query_blocks(pairs: DataFrame, block_pairs: int) -> Iterator[list[tuple]]:
    """(item_id, term, df) of one block of queries after the other: whole
    items, about ``block_pairs`` pairs and at most twice as many (an item with
    more terms than that is a block of its own)."""
    total = pairs.count()
    blocks = max(1, math.ceil(total / block_pairs))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("item_id")).alias("items")).collect()
        if not any(r.n > 2 * block_pairs and r.items > 1 for r in sizes):
            break
        blocks *= 2
    for b in sorted(r.block for r in sizes):
        yield [tuple(r) for r in dealt.where(F.col("block") == b).select("item_id", "term", "df").collect()]


def search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``top`` documents with the highest scores above 0 for each item:
    item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    Null and empty texts have no terms: such documents are never found and
    count in no statistic, such items find nothing. Rows of one item id are
    one item, a null id is an id. Repeated document rows are ranked each on
    its own, null document ids after all others. An empty table on either
    side gives no rows. Only text and doc_id are read.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType
    wanted = materialize(query_terms(items, item_id), "search-terms")
    stats = materialize(term_statistics(docs, wanted), "search-statistics")
    totals = stats.where(F.col("term") == _TOTALS).first()
    found: DataFrame | None = None
    if totals and totals.n:
        pairs = materialize(wanted.join(stats.select("term", "df"), "term").select("item_id", "term", "df"), "search-pairs")
        for rows in query_blocks(pairs, block_pairs):
            part = _search(docs, QueryBlock(rows, totals.df, totals.n), top, item_type)
            found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", docs.schema["doc_id"].dataType),
                                                       T.StructField("score", T.LongType())]))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Ten rows per task first meet in parts of an item, so that no item is one task's work.
    part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("item_id").orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return (few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
