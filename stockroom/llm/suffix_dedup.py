"""Removal of repeated byte strings with a distributed sparse suffix order.

A string of LENGTH bytes that also starts in a document with a smaller id is
removed. Suffixes are taken at anchors: the positions whose 16-byte gram has
the smallest hash of some LENGTH-byte window. Equal windows choose equal
anchors, so any shared string is seen from a shared anchor.

1. Anchors. Grams are hashed to ranges; grams of one text only are dropped.
2. Texts are grouped by digest (equal texts are one, with their smallest
   id) and meet their surviving anchors; equal surroundings within a group
   are one row.
3. Surviving suffixes are range-partitioned by their leading 16 bytes at
   splitters sampled from the data. A splitter never parts equal leading
   bytes, so no common prefix of that length crosses a boundary. Each bucket
   sorts its suffixes, and the reversed bytes before them, by multikey
   quicksort on 8-byte characters; common-prefix lengths of neighbours give
   the classes of equal strings, and each class its smallest id.
4. Verdicts return to the texts, spans are joined and bytes are cut.

Between the stages go compressed blobs, dealt by range or group; every
stage's tasks hold one bounded range or group.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.operators.ordering import with_row_id
from stockroom.session import write_once

LENGTH = 50
GRAM = 16
_BEFORE = LENGTH - GRAM  # bytes before an anchor that a window can hold
_SPAN = _BEFORE + LENGTH
# Texts of so many bytes are one group, and anchors of so many one range.
GROUP_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
BUCKET_BYTES = 6 << 20
# Splitters come from about so many sampled documents.
SAMPLE_DOCS = 2_000
# Text that one task gathers before it deals out blobs, and hashes at a time.
_GATHER = 10 << 20
_CHUNK = 256 << 10
_ROWS = 64
NO_ID = np.iinfo(np.int64).max  # null ids come after all others


def _blob(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _unblob(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _planes(a: np.ndarray) -> tuple[str, np.ndarray]:
    """Bytes of like weight side by side: compresses better."""
    return a.dtype.str, np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def _unplanes(x: tuple[str, np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(x[1].T).reshape(-1).view(x[0]) if x[1].size else np.zeros(0, x[0])


def _slide(a: np.ndarray, width: int, fn) -> np.ndarray:
    """fn over every run of ``width`` neighbours, by doubling."""
    done, out = 1, a
    while 2 * done <= width:
        out = fn(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = fn(out[:-rest], out[rest:])
    return out


def gram_hashes(buffer: bytes) -> np.ndarray:
    """64-bit hash of the GRAM bytes from every position, never 0."""
    n = len(buffer) - GRAM + 1
    words = np.ndarray((n + 8,), dtype="<u8", buffer=buffer, strides=(1,)).astype(np.uint64)
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of the anchors of texts of LENGTH bytes or
    more each, hashed together."""
    buffer = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = gram_hashes(buffer)
    low = _slide(h, _BEFORE + 1, np.minimum)  # of each window start
    low = low.copy()
    for e in ends[:-1].tolist():
        low[e - LENGTH + 1:e] = 0  # windows that would cross into the next text
    pad = np.zeros(_BEFORE, dtype=np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), _BEFORE + 1, np.maximum)
    at = np.flatnonzero(high == h)
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], h[at]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one; only a few of a batch are Python values at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, _ROWS).columns))


def _give_back() -> None:
    """Return freed memory to the system, so that a worker that did a large
    group does not hold it while it does others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass


def _gather(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows of a partition in lists of about _GATHER bytes of text."""
    held: list[tuple] = []
    size = 0
    for row in _few(batches):
        held.append(row)
        size += len(row[column] or "")
        if size >= _GATHER:
            yield held
            held, size = [], 0
            _give_back()
    if held:
        yield held
    del held
    _give_back()


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _digest(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def _rows(keys: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], keys)


_DEALT = "to int, kind int, blob binary"
_NAMES = ["to", "kind", "blob"]


def _anchor_stage(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gather(batches, 0):
            texts = sorted({r for r in (_raw(t) for (t,) in rows) if len(r) >= LENGTH})
            if not texts:
                continue
            parts, first, size = [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= _CHUNK or k == len(texts) - 1:
                    text, pos, h = anchors(texts[first:k + 1])
                    # Anchors have small hashes: multiplied, they spread over all ranges.
                    parts.append((text + first, pos, (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)))
                    first, size = k + 1, 0
            text, pos, key = (np.concatenate(x) for x in zip(*parts))
            tids = np.array([_digest(t) for t in texts], dtype=np.uint64)
            order = np.lexsort((text, key))
            text, pos, key = text[order], pos[order], key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.append(starts, len(key)))
            many = text[starts] != text[starts + lengths - 1]
            in_many = np.repeat(many, lengths)
            shared = key[starts[many]]
            # Grams of several texts here survive anyway: their anchors pass
            # through a range chosen by text, the gram itself goes once.
            p_text, p_pos = text[in_many], pos[in_many]
            text, pos, key = text[~in_many], pos[~in_many], key[~in_many]
            span = np.uint64((1 << 48) // ranges + 1)
            home = (tids % np.uint64(ranges)).astype(np.int64)[p_text]
            by_home = np.argsort(home, kind="stable")
            home, p_text, p_pos = home[by_home], p_text[by_home], p_pos[by_home]
            # Only ranges that get something: work and blobs are at most as many as anchors.
            to = np.unique(np.concatenate([key // span, shared // span, home.astype(np.uint64)])).astype(np.int64)
            ends = np.append(to, ranges).astype(np.uint64)
            cuts, s_cuts, h_cuts = (np.searchsorted(x, ends * w) for x, w in ((key, span), (shared, span), (home.astype(np.uint64), np.uint64(1))))
            to, blobs = to.tolist(), []
            for r in range(len(to)):
                a, b, mine = cuts[r], cuts[r + 1], slice(h_cuts[r], h_cuts[r + 1])
                used, index = np.unique(np.concatenate([text[a:b], p_text[mine]]), return_inverse=True)
                small = np.uint16 if len(used) < 65536 else np.uint32
                blobs.append(_blob((tids[used], _planes(np.diff(key[a:b], prepend=np.uint64(0))), _planes(pos[a:b].astype(np.uint32)),
                                    _planes(index.astype(small)), shared[s_cuts[r]:s_cuts[r + 1]], p_pos[mine].astype(np.uint32))))
            yield _rows(_NAMES, to, [0] * len(to), blobs)
    return run


def _by_key(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of equal first column of a partition sorted by it."""
    held: list[tuple] = []
    for row in _few(batches):
        if held and held[0][column] != row[column]:
            yield held[0][column], held
            held = []
            _give_back()
        held.append(row)
    if held:
        yield held[0][column], held
    del held
    _give_back()


def _range_stage(groups: int):
    """Anchors of grams that several texts hold, dealt to the texts' groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            keys, tids, poss, shared, p_tids, p_poss = [], [], [], [], [], []
            for _, _, blob in rows:
                table, key, pos, index, more, p_pos = _unblob(blob)
                key, pos, index = np.cumsum(_unplanes(key), dtype=np.uint64), _unplanes(pos), _unplanes(index)
                keys.append(key), poss.append(pos), tids.append(table[index[:len(key)]])
                shared.append(more), p_poss.append(p_pos), p_tids.append(table[index[len(key):]])
            key, pos, tid = np.concatenate(keys), np.concatenate(poss), np.concatenate(tids)
            order = np.lexsort((tid, key))
            key, pos, tid = key[order], pos[order], tid[order]
            if len(key):
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                lengths = np.diff(np.append(starts, len(key)))
                several = (tid[starts] != tid[starts + lengths - 1]) | np.isin(key[starts], np.concatenate(shared))
                keep = np.repeat(several, lengths)
                tid, pos = tid[keep], pos[keep]
            tid, pos = np.concatenate([tid, *p_tids]), np.concatenate([pos, *p_poss])
            group = (tid % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            to, starts = np.unique(group[order], return_index=True)
            cuts = np.append(starts, len(order))
            yield _rows(_NAMES, to.tolist(), [0] * len(to), [_blob((tid[order[a:b]], pos[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])])
    return run


def _text_stage(groups: int, id_at: int):
    """Texts dealt to their digest's group, equal texts of a task once with
    the row (all other columns) of the smallest id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gather(batches, 0):
            held: dict[bytes, tuple] = {}
            for text, *row in rows:
                raw = _raw(text)
                if raw not in held or row[id_at] < held[raw][id_at]:
                    held[raw] = tuple(row)
            dealt: dict[int, list] = {}
            for raw in sorted(held):
                tid = _digest(raw)
                dealt.setdefault(tid % groups, []).append((tid, raw, [held[raw]]))
            yield _rows(_NAMES, list(dealt), [1] * len(dealt), [_blob(x) for x in dealt.values()])
    return run


class _Text:
    """One distinct text of a group with the rows that hold it."""

    __slots__ = ("raw", "rows", "low", "at")

    def __init__(self, raw: bytes, rows: list[tuple], at: np.ndarray | None, id_at: int):
        self.raw, self.rows, self.at = raw, rows, at
        self.low = min((NO_ID if r[id_at] is None else r[id_at]) for r in rows)


def _surroundings(texts: list[_Text]) -> tuple[np.ndarray, ...]:
    """Distinct surroundings of the texts' anchors. Returns (bytes, before,
    after, smallest id, owner text, number of each anchor's surrounding, its
    text, its position); ``before`` and ``after`` count the bytes that exist."""
    pad = bytes(LENGTH)
    buffer = pad + b"".join(t.raw + pad for t in texts)
    sizes = np.array([len(t.raw) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + LENGTH)[:-1]]) + LENGTH
    text = np.repeat(np.arange(len(texts)), [len(t.at) for t in texts])
    pos = np.concatenate([t.at for t in texts]).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, dtype=np.uint8), _SPAN)
    before, after = np.minimum(pos, _BEFORE), np.minimum(sizes[text] - pos, LENGTH)
    around = np.concatenate([view[begin[text] + pos - _BEFORE], before[:, None].astype(np.uint8), after[:, None].astype(np.uint8)], axis=1)
    # Bytes beyond the text's ends are pad.
    col = np.arange(_SPAN)
    around[:, :_SPAN][(col < _BEFORE - before[:, None]) | (col >= _BEFORE + after[:, None])] = 0
    order, breaks = _sorted_rows(around)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(breaks) - 1
    low = np.array([t.low for t in texts], dtype=np.int64)[text]
    first = np.flatnonzero(breaks)
    lows = np.minimum.reduceat(low[order], first)
    lead = order[first]
    return around[lead, :_SPAN], before[lead], after[lead], lows, number, text, pos, low


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte characters."""
    width = -rows.shape[1] % 8
    if width:
        rows = np.concatenate([rows, np.zeros((len(rows), width), dtype=np.uint8)], axis=1)
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of characters: all rows by the first character, then
    only the runs of equals by the next, and so on."""
    order = np.argsort(words[:, 0], kind="quicksort")
    run = np.zeros(len(order), dtype=np.int64)
    run[1:] = np.cumsum(words[order[1:], 0] != words[order[:-1], 0])
    for k in range(1, words.shape[1]):
        same = run[1:] == run[:-1]
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(tied):
            break
        rows = order[tied]
        inner = np.lexsort((words[rows, k], run[tied]))
        order[tied] = rows[inner]
        step = np.concatenate([[0], np.diff(run)])
        step[1:] |= (run[1:] == run[:-1]) & (words[order[1:], k] != words[order[:-1], k])
        run = np.cumsum(step)
    return order


def _sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each sorted row differs from the one before)."""
    words = _words(rows)
    order = multikey_order(words)
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return order, breaks


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common-prefix length of each sorted row with the one before."""
    out = np.zeros(len(order), dtype=np.int64)
    for lo in range(1, len(order), 65536):
        hi = min(len(order), lo + 65536)
        differ = rows[order[lo:hi]] != rows[order[lo - 1:hi - 1]]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def shared_offsets(around: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every surrounding, the least and largest number of bytes before
    the anchor at which a whole window also stands in a smaller document
    (-1, -1: none)."""
    n = len(around)
    right, left = around[:, _BEFORE:], np.ascontiguousarray(around[:, :_BEFORE][:, ::-1])
    r_order, l_order = multikey_order(_words(right)), multikey_order(_words(left))
    r_common, l_common = _common(right, r_order), _common(left, l_order)
    least, most = np.full(n, -1), np.full(n, -1)
    r_class, l_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(_BEFORE + 1):
        rows = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(rows) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < LENGTH - o)
        l_class[l_order] = np.cumsum(l_common < o) if o else 0
        key = l_class[rows] * (n + 1) + r_class[rows]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        best = np.repeat(np.minimum.reduceat(low[rows[order]], first), np.diff(np.append(first, len(key))))
        hit = rows[order][low[rows[order]] > best]
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return least, most


def _held_texts(rows: list[tuple], id_at: int) -> tuple[list[_Text], list[_Text]]:
    """(texts with anchors, texts without) of one group's blobs, in a fixed order."""
    tids, poss, held = [], [], {}
    for _, kind, blob in rows:
        if kind == 0:
            tid, pos = _unblob(blob)
            tids.append(tid), poss.append(pos)
        else:
            for tid, raw, own in _unblob(blob):
                # Of equal texts, however many rows hold them, one row is kept.
                held[tid, raw] = [min([*held.get((tid, raw), []), *own], key=lambda r: r[id_at])]
    tid = np.concatenate(tids) if tids else np.zeros(0, dtype=np.uint64)
    pos = np.concatenate(poss) if poss else np.zeros(0, dtype=np.uint32)
    order = np.lexsort((pos, tid))
    tid, pos = tid[order], pos[order]
    with_, without = [], []
    for (t, raw), own in sorted(held.items(), key=lambda x: x[0]):
        a, b = np.searchsorted(tid, [np.uint64(t)])[0], np.searchsorted(tid, [np.uint64(t)], side="right")[0]
        at = np.unique(pos[a:b])
        at = at[at.astype(np.int64) + GRAM <= len(raw)]
        (with_ if len(at) else without).append(_Text(raw, own, at, id_at))
    return with_, without


def _group_stage(splitters: np.ndarray, id_at: int, with_text: bool):
    """Kind 0: surroundings to their bucket. Kind 1: texts with anchors, to be
    cut later. Kind 2: texts that share nothing: their length and digest, and
    the text itself only if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _by_key(batches):
            with_, without = _held_texts(rows, id_at)
            for k in range(0, len(without), 256):
                yield _rows(_NAMES, [group], [2], [_blob([(t.raw if with_text else None, t.rows, t.low, (len(t.raw), hashlib.sha256(t.raw).hexdigest()))
                                                        for t in without[k:k + 256]])])
            if not with_:
                continue
            around, before, after, low, *_ = _surroundings(with_)
            lead = np.ascontiguousarray(around[:, _BEFORE:_BEFORE + GRAM]).view(f"S{GRAM}").reshape(-1)
            bucket = np.searchsorted(splitters, lead, side="right")
            order = np.lexsort((lead, bucket))
            to, starts = np.unique(bucket[order], return_index=True)
            for b, mine in zip(to.tolist(), np.split(order, starts[1:])):
                yield _rows(_NAMES, [b], [0], [_blob((group, mine, around[mine], before[mine].astype(np.uint8),
                                                      after[mine].astype(np.uint8), low[mine]))])
            for k in range(0, len(with_), 256):
                yield _rows(_NAMES, [group], [1], [_blob([(t.raw, t.rows, t.low, t.at) for t in with_[k:k + 256]])])
    return run


def _bucket_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of one bucket's surroundings, dealt back to the groups."""
    for _, rows in _by_key(batches):
        parts = [_unblob(blob) for _, _, blob in rows]
        around, before, after, low = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5))
        least, most = shared_offsets(around, before, after, low)
        lo = 0
        for group, number, *_ in parts:
            hi = lo + len(number)
            hit = np.flatnonzero(least[lo:hi] >= 0)
            if len(hit):
                yield _rows(_NAMES, [group], [0], [_blob((number[hit], least[lo:hi][hit], most[lo:hi][hit]))])
            lo = hi


def _merge(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans; touching spans are one run."""
    order = np.argsort(begin, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(begin[order].tolist(), end[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that the rest stays text."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _finish(keep: list[str], types: list, id_at: int, with_text: bool):
    """Result rows of finished texts and of texts with their verdicts."""
    names = [*keep, *(["text"] if with_text else []), "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def results(texts: list[tuple]) -> pa.RecordBatch:
        """Rows of (raw, rows, low, spans, (length, digest) if nothing is cut)."""
        cols: list[list] = [[] for _ in names]
        for raw, rows, low, spans, facts in texts:
            size, digest = facts or (len(raw), None)
            for own, smallest in ((spans, True), ([(0, size)] if size >= LENGTH else [], False)):
                mine = [r for r in rows if ((NO_ID if r[id_at] is None else r[id_at]) == low) == smallest]
                if not mine:
                    continue
                uncut = digest is not None and not own
                gone = own == [(0, size)]
                text = []
                if with_text:
                    text = ["" if gone else _kept(raw, _whole_characters(raw, own)).decode("utf-8", "replace")]
                sha = digest if uncut else hashlib.sha256(b"" if gone else _kept(raw, own)).hexdigest()
                for r in mine:
                    for c, v in zip(cols, [*r, *text, size, sum(b - a for a, b in own), len(own), sha]):
                        c.append(v)
        kinds = [*types, *([pa.string()] if with_text else []), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            texts, verdicts = [], []
            for _, kind, blob in rows:
                if kind == 0:
                    verdicts.append(_unblob(blob))
                    continue
                if kind == 2:
                    yield results([(raw, own, low, [], facts) for raw, own, low, facts in _unblob(blob)])
                else:
                    texts += [_Text(raw, own, at, id_at) for raw, own, _, at in _unblob(blob)]
            if not texts:
                continue
            texts.sort(key=lambda t: (_digest(t.raw), t.raw))
            around, before, after, lows, number, text, pos, low = _surroundings(texts)
            least, most = np.full(len(around), -1), np.full(len(around), -1)
            for which, a, b in verdicts:
                least[which], most[which] = a, b
            # A text that shares its surrounding with a smaller one of its
            # group is covered by all whole windows around the anchor.
            b_at, a_at = before[number], after[number]
            first, last = np.maximum(LENGTH - a_at, 0), b_at
            covered = (low > lows[number]) & (first <= last)
            lo = np.where(covered, first, least[number])
            hi = np.where(covered, last, most[number])
            hit = np.flatnonzero(lo >= 0)
            begin, end = pos[hit] - hi[hit], pos[hit] - lo[hit] + LENGTH
            cuts = np.searchsorted(text[hit], np.arange(len(texts) + 1))
            for k in range(0, len(texts), 256):
                yield results([(t.raw, t.rows, t.low, _merge(begin[cuts[i]:cuts[i + 1]], end[cuts[i]:cuts[i + 1]]), None)
                               for i, t in enumerate(texts[k:k + 256], k)])
    return run


def _dealt(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Blobs of one range, group or bucket together in a task, in order."""
    return df.repartition("to").sortWithinPartitions("to", "kind", F.xxhash64("blob")).mapInArrow(fn, schema)


def _splitters(docs: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Leading bytes that part the suffixes of a sample of documents into
    ``buckets`` even ranges; the sample is bounded, so is what is sent."""
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < max(1, min(1_000_000, 1_000_000 * SAMPLE_DOCS // max(1, total)))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gather(batches, 0):
            found: list[bytes] = []
            for raw in {_raw(t) for (t,) in rows}:
                if len(raw) >= LENGTH:
                    found += [raw[p:p + GRAM] for p in anchors([raw])[1].tolist()[::4]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["lead"])

    if buckets < 2:
        return np.zeros(0, dtype=f"S{GRAM}")
    got = sorted(bytes(r.lead) for r in docs.where(share).select("text").mapInArrow(lead, "lead binary").distinct().collect())
    marks = [got[len(got) * k // buckets] for k in range(1, buckets)] if got else []
    return np.array(sorted(set(marks)), dtype=f"S{GRAM}")


def _ordered_ids(docs: DataFrame) -> bool:
    """Whether ids are whole numbers, which are compared as they are."""
    return isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _with_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id``: the id as a number of the same order, null ids last."""
    if _ordered_ids(docs):
        number = F.col("doc_id").cast("long")
    else:
        ids = docs.select("doc_id").where("doc_id is not null").distinct()
        ranks = write_once(with_row_id(ids, ["doc_id"], "__id", unique=True).withColumnRenamed("doc_id", "__rank_of"), "suffix-ids")
        docs, number = docs.join(ranks, F.col("doc_id") == F.col("__rank_of"), "left").drop("__rank_of"), F.col("__id")
    return docs.withColumn("__id", F.coalesce(number, F.lit(int(NO_ID))))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns (default doc_id), n_bytes,
    n_removed, n_spans, kept_sha256, and with ``with_text`` the text that is
    left (spans shrunk to whole characters).

    Null texts are empty; texts shorter than LENGTH lose nothing; rows that
    repeat the text of a smaller id lose all of it; rows of equal id never
    cut each other; null ids come after all others; ids of any type that can
    be ordered do. Empty input gives no rows. Anchors, groups and buckets
    cover all texts whole. A kept column named like a result gives way to it.
    """
    results = [*(["text"] if with_text else []), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in results]
    own = [f"__k{i}" for i in range(len(keep))]
    rows = _with_order(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own)]))
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "__id", *own).withColumn("__digest", F.unhex(F.md5("text")))
    # One verdict per distinct text, for the row of its smallest id; the rows meet it by digest, without their
    # texts. A digest that very many rows hold is split by AQE: the verdict's side is one row.
    verdict = _remove_repeats(rows.select("text", "__digest", "__id"), ["__digest"], with_text).withColumnRenamed("__id", "__low")
    met = rows.select("__digest", "__id", *own).join(verdict, "__digest")
    gone = (F.col("__id") != F.col("__low")) & (F.col("n_bytes") >= LENGTH)
    whole = {"text": F.lit(""), "n_bytes": F.col("n_bytes"), "n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"),
             "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return met.select(*[F.col(k).alias(c) for k, c in zip(own, keep)],
                      *[F.when(gone, whole[c]).otherwise(F.col(c)).alias(c) for c in results])


def _remove_repeats(texts: DataFrame, own: list[str], with_text: bool) -> DataFrame:
    """One row per distinct text of (text, own columns, __id): the own columns
    and id of its row with the smallest id, and what is cut from it there."""
    from pyspark.sql.pandas.types import to_arrow_type

    total, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()
    ranges, groups, buckets = (max(1, math.ceil(size / b)) for b in (RANGE_BYTES, GROUP_BYTES, BUCKET_BYTES))
    id_at = len(own)
    splitters = _splitters(texts, total, buckets)
    anchored = texts.select("text").mapInArrow(_anchor_stage(ranges), _DEALT)
    surviving = _dealt(anchored, _range_stage(groups), _DEALT)
    grouped = surviving.unionAll(texts.mapInArrow(_text_stage(groups, id_at), _DEALT))
    # Read by both branches below: the exchange is shared, the stage runs twice.
    staged = _dealt(grouped, _group_stage(splitters, id_at, with_text), _DEALT)
    verdicts = _dealt(staged.where("kind = 0"), _bucket_stage, _DEALT)
    columns = [*own, "__id"]
    fields = [texts.schema[c] for c in columns]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + ([T.StructField("text", T.StringType())] if with_text else [])
                          + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    finish = _finish(columns, [to_arrow_type(f.dataType) for f in fields], id_at, with_text)
    return _dealt(verdicts.unionAll(staged.where("kind > 0")), finish, schema)
