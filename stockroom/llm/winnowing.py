"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item, or all words of
a shorter item. Document words inside any occurrence of a window are hit.

1. Fingerprints. Of every run of k-grams that a window spans, the one with
   the smallest hash is kept, in documents and items alike: equal windows keep
   equal grams, so every shared window shares a fingerprint.
2. Join. Document fingerprints meet the items' distinct fingerprints in a
   semi join, which multiplies nothing however common a gram is.
3. Extension. Texts with a shared fingerprint are read again; every window
   around a shared gram is joined word for word to the items' distinct
   windows. Only windows that occur meet the items that hold them.

Shorter items make a shorter guarantee necessary: the run of grams is as long
as the shortest item of at least k words allows, and items below k words have
grams of their own length. Equal texts are told by a 128-bit key and extended
results are computed once for all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.llm.common import materialize
from stockroom.llm.slices import WordHashes, folded_words, kept_columns, map_texts

WINDOW = 10
GRAM = 5
_KEY = ["_text_key_a", "_text_key_b"]
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _text_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias(_KEY[0]), F.xxhash64(F.lit("second"), text).alias(_KEY[1])]


def families(lengths: list[int], gram: int) -> list[tuple[int, int, list[int]]]:
    """(words of a gram, grams of a run, window lengths served) so that every
    window of the given lengths keeps a gram."""
    long = [n for n in lengths if n >= gram]
    out = [(gram, min(long) - gram + 1, sorted(long))] if long else []
    return out + [(n, 1, [n]) for n in sorted(lengths) if n < gram]


def gram_values(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` words from every position; empty if there are fewer."""
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, gram, dtype=np.uint64)
    for k in range(gram):
        h = (h ^ (h >> np.uint64(29))) * _PRIME + hashes[k:k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


def _slide(a: np.ndarray, width: int, fn: np.ufunc) -> np.ndarray:
    """fn over every run of ``width`` neighbours, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = fn(out[:-step], out[step:])
        done += step
    return out


def winnowed(hashes: np.ndarray, owner: np.ndarray, gram: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of texts laid end to end: ``owner`` is the text of
    each word. A gram is kept if it is the smallest of some run of grams
    inside its text; the same one next to itself is kept once."""
    span = gram + run - 1
    if len(hashes) < span:
        return np.zeros(0, dtype=owner.dtype), np.zeros(0, dtype=np.uint64)
    values = gram_values(hashes, gram)
    low = _slide(values, run, np.minimum).copy()
    low[owner[:len(low)] != owner[span - 1:]] = 0  # runs that cross into the next text
    pad = np.zeros(run - 1, dtype=np.uint64)
    at = np.flatnonzero(values == _slide(np.concatenate([pad, low, pad]), run, np.maximum))
    text, value = owner[at], values[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """Values sorted by their owner as one list per owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _fingerprints(words: list[list[bytes]], hashes: WordHashes, wanted: list[tuple[int, int, list[int]]]) -> pa.Array:
    """Fingerprints of every family as one list per text."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate([hashes.of(w) for w in words])
    found = [winnowed(flat, owner, gram, run) for gram, run, _ in wanted]
    text = np.concatenate([np.zeros(0, dtype=np.int64), *(t for t, _ in found)])
    value = np.concatenate([np.zeros(0, dtype=np.uint64), *(v for _, v in found)])
    order = np.argsort(text, kind="stable")
    return _lists(text[order], pa.array(value[order].view(np.int64), pa.int64()), len(words))


def item_windows(items: DataFrame, item_id: str, window: int, gram: int) -> tuple[DataFrame, list[tuple[int, int, list[int]]]]:
    """(item, fingerprints, windows) of every item with words, and the
    families; ``item`` is the id's text (null id: empty)."""
    named = items.select(F.col("text"), F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"))

    def count(texts: list[bytes], _: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([min(len(folded_words(t)), window) for t in texts], pa.int64())]

    lengths = [r.n for r in map_texts(named, [], count, [T.StructField("n", T.LongType())])
               .where("n > 0").distinct().collect()]  # at most ``window`` rows
    wanted = families(lengths, gram)

    def cut(texts: list[bytes], _: list[pa.Array]) -> list[pa.Array]:
        hashes, words = WordHashes(), [folded_words(t) for t in texts]
        fps: list[list[int]] = []
        for w in words:
            n = min(len(w), window)
            own = [f for f in wanted if n in f[2]]
            fps += _fingerprints([w], hashes, own).to_pylist() if n else [[]]
        windows = [[b" ".join(w[k:k + window]).decode("utf-8", "replace") for k in range(max(1, len(w) - window + 1))] if w else []
                   for w in words]
        return [pa.array(fps, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.string()))]

    table = map_texts(named, ["item"], cut, [T.StructField("fps", T.ArrayType(T.LongType())),
                                             T.StructField("windows", T.ArrayType(T.StringType()))])
    return materialize(table, "winnow-items"), wanted


def _candidate_windows(wanted: list[tuple[int, int, list[int]]]):
    """Windows around the grams of a text that an item shares."""
    def cut(texts: list[bytes], others: list[pa.Array]) -> list[pa.Array]:
        hashes, begin, text, out = WordHashes(), [0], [], []
        for raw, fps in zip(texts, others[len(_KEY)].to_pylist()):
            words = folded_words(raw)
            values, shared = hashes.of(words), np.array(fps, dtype=np.int64).view(np.uint64)
            for gram, _, lengths in wanted:
                at = np.flatnonzero(np.isin(gram_values(values, gram), shared))
                for n in lengths if len(at) else []:
                    first = np.unique((at[:, None] - np.arange(n - gram + 1)).ravel())
                    for s in first[(first >= 0) & (first + n <= len(words))].tolist():
                        out.append(s)
                        text.append(b" ".join(words[s:s + n]).decode("utf-8", "replace"))
            begin.append(len(out))
        struct = pa.StructArray.from_arrays([pa.array(out, pa.int64()), pa.array(text, pa.string())], ["start", "window"])
        return [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), struct)]
    return cut


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, item_id: str = "item_id",
                  window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` the ``keep`` columns (default doc_id), n_words, n_hit
    (words inside an occurrence of any item's window) and items (the ids, as
    text, of the items with occurring windows, sorted).

    Null and empty texts have no words. Items without words count for
    nothing; rows of one item id are one item, a null id counts as the empty
    text. Repeated documents get equal results. No items, no documents: no
    hits, no rows. A kept column named like a result gives way to it.
    """
    results = [T.StructField("n_words", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType()))]
    columns = kept_columns(docs, keep, ["n_words", "n_hit", "items", "fps", *_KEY])
    table, wanted = item_windows(items, item_id, window, gram)
    grams = table.select(F.explode("fps").alias("fp")).distinct()
    held = materialize(table.select("item", F.explode("windows").alias("window")).distinct(), "winnow-windows")

    def fingerprint(texts: list[bytes], _: list[pa.Array]) -> list[pa.Array]:
        words = [folded_words(t) for t in texts]
        return [pa.array([len(w) for w in words], pa.int64()), _fingerprints(words, WordHashes(), wanted)]

    keyed = docs.select("text", *[F.col(f"`{c}`") for c in columns], *_text_key())
    facts = materialize(map_texts(keyed, [*columns, *_KEY], fingerprint, results), "winnow-documents")
    shared = materialize(facts.select(*_KEY, F.explode("fps").alias("fp")).join(materialize(grams, "winnow-grams"), "fp", "left_semi")
                         .groupBy(*_KEY).agg(F.collect_set("fp").alias("fps")), "winnow-shared")
    around = map_texts(keyed.select("text", *_KEY).join(shared, _KEY), [*_KEY, "fps"], _candidate_windows(wanted),
                       [T.StructField("windows", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                                           T.StructField("window", T.StringType())])))])
    spots = around.select(*_KEY, F.explode("windows").alias("w")).select(*_KEY, "w.start", "w.window").distinct()
    occurring = materialize(spots.join(held.select("window").distinct(), "window", "left_semi"), "winnow-hits")
    end = F.col("start") + F.size(F.split("window", " "))
    merged = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
                         lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"),
                                                 (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n")),
                         lambda acc: acc["n"])
    hit = (occurring.groupBy(*_KEY).agg(F.collect_set(F.struct("start", end.cast("long").alias("end"))).alias("spans"))
           .select(*_KEY, merged.alias("n_hit")))
    named = (occurring.select(*_KEY, "window").distinct().join(held, "window").groupBy(*_KEY)
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    verdicts = materialize(hit.join(named, _KEY), "winnow-verdicts")
    return facts.join(verdicts, _KEY, "left").select(
        *[F.col(f"`{c}`") for c in columns], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
