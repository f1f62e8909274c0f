"""Order-preserving packing of tokenised documents into training sequences.

Documents of a partition are one token stream. Dynamic programming over the
stream's document and sentence ends chooses the cuts: a sequence costs its
padding, a cut inside a document costs a penalty. The cheapest start within
one window's reach is the head of a monotone queue, so every boundary costs
amortised constant time; starts at a power of two before a boundary, which
need no padding, are looked up beside it.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm.common import ARROW_ROWS

LENGTH = 1024
SENTENCE_CUT = 2.0
HARD_CUT = 12.0
# A stretch without any boundary may be cut at every so many tokens.
STRIDE = 64
# The planner looks for unpadded sequences of at least so many tokens.
LEAST_EXACT = 64
# Tokens that are planned together; the last open sequence moves on.
BLOCK_TOKENS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: bytes that
    are printable stand for themselves, the others follow from 256 upward."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return out


def load_encoder(path: str):
    """(encode function to a uint32 array, sentence-end flag per id). The
    vocabulary file's merges are run by its rank order; strings of special
    tokens in a text become their ids, as the file's own library has it.
    Kept per process and path."""
    cache = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders")).__dict__
    if path not in cache:
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of_char()
        raw = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in special}
        coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, special_tokens=special,
                                  mergeable_ranks={b: i for i, b in raw.items()})
        ends = np.zeros(max([*raw, *special.values()]) + 1, dtype=bool)
        for i, b in raw.items():
            ends[i] = b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n", b";", b"|")
        cache[path] = (lambda text: coder.encode_to_numpy(text, allowed_special="all").astype("<u4"), ends)
    return cache[path]


def plan_cuts(pos: list[int], penalty: list[float], length: int = LENGTH) -> list[int]:
    """Indices into ``pos`` (rising, from 0, steps of at most ``length``) where
    sequences end, the last boundary included; cheapest by padding plus the
    penalties of the cuts. Ties: the longer sequence."""
    m = len(pos)
    at = np.array(pos)
    exact: dict[int, list[int]] = {}
    size = LEAST_EXACT
    while size < length:
        j = np.searchsorted(at, at - size)
        found = np.flatnonzero((j < np.arange(m)) & (at[np.minimum(j, m - 1)] == at - size))
        for i, k in zip(found.tolist(), j[found].tolist()):
            exact.setdefault(i, []).append(k)
        size *= 2
    cost = [0.0] * m
    back = [0] * m
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (cost + position, index), rising
    for i in range(1, m):
        here = pos[i]
        while pos[queue[0][1]] < here - length:
            queue.popleft()
        best, start = queue[0]
        best += length - here
        for k in exact.get(i, ()):
            if cost[k] < best:
                best, start = cost[k], k
        best += penalty[i]
        cost[i], back[i] = best, start
        value = best + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, i))
    cuts = []
    i = m - 1
    while i > 0:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


def tail_cuts(n: int, length: int = LENGTH, penalty: float = HARD_CUT) -> list[int]:
    """Ends of the sequences that hold the last ``n`` tokens of a stream: the
    rest may be split off at powers of two where that beats its padding."""
    best: dict[int, tuple[float, int]] = {}

    def solve(k: int) -> float:
        if k not in best:
            options = [(0.0 if k & (k - 1) == 0 else float(length - k), k)]
            size = 1
            while size < k:
                if 2 * size >= k:  # only the largest: the rest is smaller than it
                    options.append((penalty + solve(k - size), size))
                size *= 2
            best[k] = min(options)
        return best[k][0]

    solve(n)
    ends, done = [], 0
    while done < n:
        done += best[n - done][1]
        ends.append(done)
    return ends


class _Stream:
    """Tokens of whole documents not yet dealt to sequences."""

    def __init__(self, first_sequence: int, length: int, ends: np.ndarray):
        self.sequence, self.length, self.ends = first_sequence, length, ends
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, tokens of it dealt already, its tokens)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.held += len(ids)

    def deal(self, last: bool) -> Iterator[tuple]:
        """Pieces of the planned sequences; the last one stays unless ``last``."""
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([n - done for _, done, n in self.docs])
        penalty = np.full(len(ids) + 1, np.inf)
        penalty[np.flatnonzero(self.ends[ids]) + 1] = SENTENCE_CUT
        penalty[doc_ends] = 0.0
        penalty[0] = 0.0
        marks = np.flatnonzero(np.isfinite(penalty))
        for lo, hi in zip(marks[:-1][np.diff(marks) > self.length].tolist(), marks[1:][np.diff(marks) > self.length].tolist()):
            penalty[lo + STRIDE:hi:STRIDE] = HARD_CUT
        marks = np.flatnonzero(np.isfinite(penalty))
        chosen = plan_cuts(marks.tolist(), penalty[marks].tolist(), self.length)
        cuts = marks[chosen].tolist()
        if not last:
            cuts.pop()
        else:
            start = cuts[-2] if len(cuts) > 1 else 0
            cuts[-1:] = [start + e for e in tail_cuts(len(ids) - start, self.length)]
        upto = cuts[-1] if cuts else 0
        starts = [0, *cuts[:-1]]
        doc, lo = 0, 0
        for begin, end in zip(starts, cuts):
            lo = begin
            while lo < end:
                doc_id, done, n = self.docs[doc]
                hi = min(end, int(doc_ends[doc]))
                own = n - int(doc_ends[doc]) + lo
                yield doc_id, own, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, self.sequence, lo - begin
                lo = hi
                if hi == doc_ends[doc]:
                    doc += 1
            self.sequence += 1
        rest = self.docs[doc:]
        if rest:
            doc_id, _, n = rest[0]
            rest[0] = (doc_id, n - int(doc_ends[doc]) + upto, n)
        self.docs, self.ids, self.held = rest, [ids[upto:]], len(ids) - upto


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Order is kept within each input partition; sequence ids hold the
    partition's number above bit 40. Null and empty texts are the single end
    token; repeated rows are packed each; extra columns are ignored; empty
    input gives no rows. Documents of any length are packed whole.
    """
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = load_encoder(vocabulary)
        stream = _Stream(TaskContext.get().partitionId() << 40, length, ends)
        end = np.zeros(1, dtype="<u4")
        kind = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces)) if pieces else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                              schema.fieldNames())

        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(0, batch.num_rows, ARROW_ROWS):
                rows = batch.slice(k, ARROW_ROWS)
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    stream.add(doc_id, np.concatenate([encode(text or ""), end]))
                    if stream.held >= BLOCK_TOKENS:
                        yield batch_of(list(stream.deal(last=False)))
        if stream.held:
            yield batch_of(list(stream.deal(last=True)))

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
