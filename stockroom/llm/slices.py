"""Arrow batches of whole texts cut into slices of bounded bytes.

Spark bounds a batch by bytes itself; a slice bounds what a task holds as
Python words at a time. No session setting is touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm import common  # noqa: F401  (functions travel by value)

# Bytes of text that a task works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
_ASCII_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list[bytes], list[pa.Array]]]:
    """(texts as UTF-8, the other columns) of slices of rows in order; the
    text is the first column, null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(0).cast(pa.binary())
        begin, size = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if k > begin and size + n > limit:
                yield _cut(texts, batch, begin, k)
                begin, size = k, 0
            size += n
        yield _cut(texts, batch, begin, batch.num_rows)


def _cut(texts: pa.Array, batch: pa.RecordBatch, begin: int, end: int) -> tuple[list[bytes], list[pa.Array]]:
    return ([t or b"" for t in texts.slice(begin, end - begin).to_pylist()],
            [batch.column(c).slice(begin, end - begin) for c in range(1, batch.num_columns)])


def pieces(raw: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes, cut at white space."""
    begin = 0
    while len(raw) - begin > limit:
        found = _ASCII_SPACE.search(raw, begin + limit)
        if not found:
            break
        yield raw[begin:found.start()]
        begin = found.start()
    yield raw[begin:] if begin else raw


def kept_columns(docs: DataFrame, keep: list[str] | None, results: list[str]) -> list[str]:
    """Columns of ``docs`` to return (default doc_id); one that is named like
    a result gives way to it."""
    return [c for c in (keep if keep is not None else ["doc_id"]) if c in docs.columns and c not in results]


def map_texts(docs: DataFrame, columns: list[str], fn: Callable[[list[bytes], list[pa.Array]], list[pa.Array]],
              results: list[T.StructField]) -> DataFrame:
    """``columns`` of ``docs`` and the result columns that ``fn`` makes of each
    slice of texts (and of the other columns), row by row."""
    names = [*columns, *[f.name for f in results]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, others in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*others, *fn(texts, others)], names)

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + results)
    return docs.select(F.col("text"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


# Bytes of a text's lower-cased words: ASCII letters and digits and all bytes
# beyond ASCII; every other byte parts words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def folded_words(raw: bytes) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and characters beyond
    ASCII, only A-Z lower-cased."""
    return raw.translate(_FOLD).split()


class WordHashes(dict):
    """64-bit hash of a word, remembered for the most recent million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Collection[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
