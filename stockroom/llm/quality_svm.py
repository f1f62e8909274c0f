"""Quality classifier: naive Bayes support vector machine.

N-gram indicators are scaled by class log-count ratios; a linear hinge-loss
model is fitted on them by dual coordinate descent. N-grams are byte
trigrams (case and symbols matter) and short patterns of word repetition,
hashed to a fixed number of columns, so the model has a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import crc_fold, map_batches, materialize
from stockroom.llm.toxicity import training_sample

# Labelled rows that the model is fitted on, at most about so many.
MAX_TRAIN = 8_000
BITS = 18
ALPHA = 1.0
COST = 1.0
EPOCHS = 12
SEED = 4
_COLUMNS = 1 << BITS
# Columns for repetition patterns come after those of the trigrams.
_PATTERNS = 64


def ngram_columns(text: str | None) -> np.ndarray:
    """Distinct columns (rising) of one text; an empty text has none."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(0, dtype=np.uint32)
    padded = np.concatenate([[np.uint32(10)], raw, [np.uint32(10)]]).astype(np.uint32)
    grams = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return np.concatenate([np.unique(hashed), _repetition(text)])


def _repetition(text: str) -> np.ndarray:
    """Patterns over words: runs of equal neighbours (1, 2, 3 or more), and
    how much of the text repeats: distinct words and lines in tenths."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    same = [a == b for a, b in zip(words, words[1:])]
    found = set()
    if True in same:
        found.add(0)
        pairs = [a and b for a, b in zip(same, same[1:])]
        if True in pairs:
            found.add(1)
            if any(a and b for a, b in zip(pairs, pairs[1:])):
                found.add(2)
    found.add(4 + min(9, int(10 * sum(same) / n)))
    # Long texts repeat words anyway: the share is taken against the square root law.
    found.add(16 + min(9, int(10 * len(set(words)) / n)) + (10 if n > 200 else 0))
    lines = [x for x in text.split("\n") if x.strip()]
    found.add(40 + min(9, int(10 * len(set(lines)) / max(1, len(lines)))))
    return np.array(sorted(_COLUMNS + f for f in found), dtype=np.uint32)


def fit(rows: list[tuple[int, np.ndarray]], alpha: float = ALPHA, cost: float = COST, epochs: int = EPOCHS,
        seed: int = SEED) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights with the ratios folded in, bias, ratios) from (label, columns) rows:
    log-count ratios, then dual coordinate descent on the hinge loss of the
    normalised, ratio-scaled indicators."""
    size = _COLUMNS + _PATTERNS
    counts = np.full((2, size), alpha)
    for label, cols in rows:
        counts[label, cols] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Columns that fewer than three documents have say nothing about others.
    ratio[(counts.sum(axis=0) - 2 * alpha) < 3] = 0.0
    w, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    scaled = []
    for label, cols in rows:
        x = ratio[cols]
        norm = math.sqrt(float(x @ x)) or 1.0
        scaled.append(x / norm)
    rng = np.random.default_rng(seed)
    bad = max(1, sum(1 - y for y, _ in rows))
    # Each class has the same total cost.
    caps = (cost * len(rows) / (2 * max(1, len(rows) - bad)), cost * len(rows) / (2 * bad))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            label, cols = rows[i]
            y, x = (1.0, scaled[i]) if label else (-1.0, scaled[i])
            gradient = y * (float(w[cols] @ x) + bias) - 1
            new = min(max(dual[i] - gradient / (float(x @ x) + 1.0), 0.0), caps[0 if label else 1])
            step = (new - dual[i]) * y
            if step:
                dual[i] = new
                w[cols] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias, ratio


def margin(cols: np.ndarray, weights: np.ndarray, ratio: np.ndarray, bias: float) -> float:
    x = ratio[cols]
    norm = math.sqrt(float(x @ x)) or 1.0
    return float(weights[cols].sum()) / norm + bias


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps."""
    a, b = 1.0, 0.0
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document.

    Labels are learned from rows with crc32(doc_id) mod 4 not 2 only; a fifth
    of those fits the score curve. A text without n-grams has the score of
    the bias alone; without both labels in training every score is the share
    of good training rows. Null ids are never trained on nor held out;
    repeated rows are scored each; extra columns are ignored.
    """
    spark = docs.sparkSession
    chosen = materialize(training_sample(labels, "quality", 4, 2, max_train), "quality-labels")

    def grams(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = [ngram_columns(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cols, pa.binary())], ["doc_id", "label", "cols"])

    # About max_train rows of two numbers are broadcast, and as many come to
    # the driver as column lists: bounded by the parameter.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "label", "text")
    sample = map_batches(joined, grams, "doc_id long, label int, cols binary")
    rows = sorted(((r.doc_id, r.label, np.frombuffer(r.cols, dtype="<u4")) for r in sample.toLocalIterator()),
                  key=lambda r: (r[0], r[2].tobytes()))
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    train = [(y, c) for k, (_, y, c) in enumerate(rows) if k % 5]
    rest = [(y, c) for k, (_, y, c) in enumerate(rows) if k % 5 == 0]
    if len({y for y, _ in train}) < 2:
        share = sum(y for y, _ in train) / max(1, len(train))
        scored = docs.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        weights, bias, ratio = fit(train)
        curve = rest if len({y for y, _ in rest}) == 2 else train
        a, b = platt(np.array([margin(c, weights, ratio, bias) for _, c in curve]), np.array([y for y, _ in curve]))
        model = spark.sparkContext.broadcast((weights.astype(np.float32), ratio.astype(np.float32)))
        schema = docs.select("doc_id").schema.add("score", "double")

        def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            w, r = model.value
            out = [1 / (1 + math.exp(-max(-35.0, min(35.0, a * margin(ngram_columns(t), w, r, bias) + b))))
                   for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

        scored = map_batches(docs.select("doc_id", "text"), score, schema)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
