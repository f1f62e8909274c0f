"""Periodic runs of words, found online by dyadic square catching.

A run is a stretch of consecutive words with smallest period q, at least
``exponent`` periods and ``least`` words long, that no neighbouring word
extends.

The words of a text arrive one after another. For every power of two B there
is a catcher at each completed block of B words: it watches for squares with
a period from 2B to 4B whose first half covers the block's start. A word that
arrives completes one window of words per level; two catchers of the level
can be met by it, and the window is compared with the window at their blocks
(differences of prefix sums, so a comparison is one subtraction). Equal
windows report a square; its ends are advanced word against word, which also
rules out any equal sums of different words. Squares of one period that touch
merge into a run. Runs that reach the last word stay open and advance with
the next words. A word costs two comparisons per level, n log n in all.

Words are appended in arrays, so that a level's comparisons of many words are
one vector operation. A task's stream is one text after another, each closed
by a word of its own that equals no other: no square crosses it.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stockroom.llm.slices import kept_columns, map_texts, pieces

# Words appended at a time, which bounds the vectors of a comparison.
APPEND_WORDS = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(ids: np.ndarray) -> np.ndarray:
    """64-bit values of word numbers."""
    h = ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, first: int, count: int) -> np.ndarray:
    """base**first, base**(first + 1), ... modulo 2**64."""
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = pow(base, first, 1 << 64)
    return np.cumprod(out, dtype=np.uint64)


class _Growing:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self._held, self.n = np.zeros(1024, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self._held):
            bigger = np.zeros(max(2 * len(self._held), self.n + len(more)), dtype=self._held.dtype)
            bigger[:self.n] = self._held[:self.n]
            self._held = bigger
        self._held[self.n:self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self._held[:self.n]


class SquareCatchers:
    """Online detection of the runs of a growing sequence of word numbers.

    ``exponent`` (2 or more) and ``least`` are the fewest periods and words of
    a run; ``longest`` bounds the length of a run, where the caller knows it
    (the longest text of a stream), and with it the levels.
    """

    def __init__(self, exponent: int = 2, least: int = 0, longest: int | None = None):
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.least, self.longest = exponent, least, longest
        self._ids, self._sums, self._inverse = _Growing(np.int64), _Growing(np.uint64), _Growing(np.uint64)
        self._sums.extend(np.zeros(1, dtype=np.uint64))
        self._inverse.extend(np.ones(1, dtype=np.uint64))
        self._found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self._open: dict[tuple[int, int], int] = {}  # (start, period) -> end, which is the last word's

    def append(self, ids: np.ndarray) -> None:
        """The next words."""
        for k in range(0, len(ids), APPEND_WORDS):
            self._append(np.asarray(ids[k:k + APPEND_WORDS], dtype=np.int64))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs among the words so far, by
        start, then period."""
        best = dict(self._found)
        for (s, q), e in self._open.items():
            if self._counts(s, e, q):
                best[s, e] = min(q, best.get((s, e), q))
        return sorted((s, e - s, q) for (s, e), q in best.items())

    def _counts(self, s: int, e: int, q: int) -> bool:
        return e - s >= max(self.least, self.exponent * q)

    def _append(self, ids: np.ndarray) -> None:
        before = self._ids.n
        terms = _mix(ids) * _powers(_BASE, before, len(ids))
        self._ids.extend(ids)
        self._sums.extend(self._sums.all[-1] + np.cumsum(terms, dtype=np.uint64))
        self._inverse.extend(_powers(_INVERSE, before + 1, len(ids)))
        for (s, q), e in sorted(self._open.items()):
            del self._open[s, q]
            self._report(s, e + self._forward(e - q, q), q)
        n = self._ids.n
        most = n if self.longest is None else self.longest // self.exponent
        if most >= 1:
            self._compare(before, 1, 1, 2)
        block = 1
        while 2 * block <= most:
            self._compare(before, block, 2 * block, min(4 * block, most + 1))
            block *= 2

    def _names(self, width: int, begin: int, end: int, step: int = 1) -> np.ndarray:
        """Values of the windows of ``width`` words at begin, begin + step, ..."""
        sums = self._sums.all
        return (sums[begin + width:end + width:step] - sums[begin:end:step]) * self._inverse.all[begin:end:step]

    def _compare(self, before: int, block: int, low: int, high: int) -> None:
        """Meet the windows that the words after ``before`` complete with the
        catchers of the level: periods from ``low`` up to ``high``."""
        # A run holds the start l of a block among its first ``block`` words, and
        # from there on as many words repeat after q as the run is longer than q.
        # That surplus falls with q while ``least`` decides, then grows.
        turn = self.least // self.exponent
        periods = {min(max(q, low), high - 1) for q in (low, high - 1, turn, turn + 1)}
        width = min(max(self.least, self.exponent * q) - q for q in periods) - (block - 1)
        first, last = max(before - width + 1, low), self._ids.n - width  # windows completed now
        if width < 1 or first > last:
            return
        base = first // block * block
        names = self._names(width, base, last + 1)
        rows = -(-len(names) // block)
        for back in range(low // block, -(-high // block)):
            # Words of block c meet the catcher at block c - back.
            skip = max(0, back - base // block)
            if skip >= rows:
                continue
            starts = base + (skip - back) * block
            met = self._names(width, starts, starts + (rows - skip - 1) * block + 1, block)
            window = names[skip * block:]
            hit = np.flatnonzero(window == (met if block == 1 else np.repeat(met, block)[:len(window)]))
            if len(hit):
                at = base + skip * block + hit
                catcher = starts + hit // block * block
                fits = (at >= first) & (at - catcher < high)
                if fits.any():
                    self._squares(catcher[fits], (at - catcher)[fits], width)

    def _squares(self, start: np.ndarray, period: np.ndarray, width: int) -> None:
        """Merge reported squares: windows of ``width`` words at ``start`` that
        repeat after ``period``."""
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (period[1:] != period[:-1]) | (start[1:] - start[:-1] > width)
        cuts = np.append(np.flatnonzero(new), len(start))
        known = self._known()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            q, end = int(period[a]), int(start[b - 1]) + width + int(period[a])
            if self._within(known, int(start[a]), end, q):
                continue
            at = a
            while at < b:
                s = int(start[at])
                more = self._forward(s, q)
                if more:
                    self._report(s - self._backward(s, q), s + more + q, q)
                at = max(at + 1, a + int(np.searchsorted(start[a:b], s + more)))

    def _known(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Runs so far by start, each with the furthest end up to it."""
        all_ = sorted([(s, e, q) for (s, e), q in self._found.items()] + [(s, e, q) for (s, q), e in self._open.items()])
        reach, best = [], None
        for run in all_:
            if best is None or (run[1], -run[2]) > (best[1], -best[2]):
                best = run
            reach.append(best)
        return np.array([r[0] for r in all_], dtype=np.int64), reach

    @staticmethod
    def _within(known: tuple[np.ndarray, list[tuple[int, int, int]]], begin: int, end: int, q: int) -> bool:
        """Whether the words from begin to end lie in a known run whose period
        divides q: they then belong to that run."""
        starts, reach = known
        at = int(np.searchsorted(starts, begin, side="right")) - 1
        return at >= 0 and reach[at][1] >= end and q % reach[at][2] == 0

    def _report(self, s: int, e: int, q: int) -> None:
        if e == self._ids.n:
            self._open[s, q] = e
        elif self._counts(s, e, q):
            self._found[s, e] = min(q, self._found.get((s, e), q))

    def _forward(self, at: int, q: int) -> int:
        """Words from ``at`` on that repeat after q words."""
        ids, n, done, step = self._ids.all, self._ids.n, 0, 64
        while at + q + done < n:
            size = min(step, n - at - q - done)
            differ = ids[at + done:at + done + size] != ids[at + q + done:at + q + done + size]
            if differ.any():
                return done + int(differ.argmax())
            done += size
            step *= 2
        return done

    def _backward(self, at: int, q: int) -> int:
        """Words before ``at`` that repeat after q words."""
        ids, done, step = self._ids.all, 0, 64
        while at - done > 0:
            size = min(step, at - done)
            lo = at - done - size
            differ = (ids[lo:lo + size] != ids[lo + q:lo + q + size])[::-1]
            if differ.any():
                return done + int(differ.argmax())
            done += size
            step *= 2
        return done


def _numbered(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Word numbers of each text, and the word of each number."""
    vocabulary: dict[bytes, int] = defaultdict(itertools.count().__next__)
    out = []
    for raw in texts:
        parts = []
        for piece in pieces(raw):
            words = piece.split()
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words)))
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out, list(vocabulary)


def text_runs(texts: list[np.ndarray], exponent: int, least: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of each text (word numbers of 0 and up), all caught in one stream."""
    catchers = SquareCatchers(exponent, least, max((len(t) for t in texts), default=0))
    begins, at = [], 0
    stream = []
    for k, ids in enumerate(texts):
        begins.append(at)
        stream += [ids, np.array([-1 - k], dtype=np.int64)]
        at += len(ids) + 1
    if stream:
        catchers.append(np.concatenate(stream))
    found = catchers.runs()
    owner = np.searchsorted(begins, [s for s, _, _ in found], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        yield [(s - begins[k], n, q) for s, n, q in found[cuts[k]:cuts[k + 1]]]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RESULTS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
            T.StructField("collapsed", T.StringType())]


def repeated_runs(docs: DataFrame, keep: list[str] | None = None, exponent: int = 4, least: int = 6) -> DataFrame:
    """Per row of ``docs`` the ``keep`` columns (default doc_id), n_words, the
    text's runs (array of start, length, period in words, by start, then
    period) and the collapsed text: each run's words after its first period
    dropped, the others joined by one space.

    Words are stretches without ASCII white space. Null and empty texts have
    no words, no runs and an empty collapsed text. Rows are independent, so
    repeated rows and ids get equal results; an empty table gives no rows. A
    kept column named like a result gives way to it. A text's runs are found
    whole, whatever its length, in memory in proportion to the text.
    """
    columns = kept_columns(docs, keep, [f.name for f in _RESULTS])

    def find(texts: list[bytes], _others: list[pa.Array]) -> list[pa.Array]:
        numbers, words = _numbered(texts)
        offsets, flat, collapsed = [0], [], []
        for ids, runs in zip(numbers, text_runs(numbers, exponent, least)):
            if runs:
                stays = np.ones(len(ids), dtype=bool)
                for s, n, q in runs:
                    stays[s + q:s + n] = False
                ids = ids[stays]
            flat += runs
            offsets.append(len(flat))
            collapsed.append(b" ".join(map(words.__getitem__, ids.tolist())))
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        struct = pa.StructArray.from_arrays(parts, ["start", "length", "period"])
        return [pa.array([len(x) for x in numbers], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                pa.array(collapsed, pa.binary()).cast(pa.string())]

    return map_texts(docs, columns, find, _RESULTS)

