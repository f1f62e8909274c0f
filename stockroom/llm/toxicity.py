"""Toxicity by gradient-boosted trees over dense text features.

Features: densities of a fixed lexicon and of one learned from the training
rows (whole words and word beginnings), their closeness to second-person
words, capitals, punctuation and obfuscation rates. Trees and the isotonic
calibration are Spark ML models fitted on a bounded sample of the labelled
training rows; every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import crc_fold, map_batches, materialize

# Labelled rows that the model is fitted on, at most about so many.
MAX_TRAIN = 20_000
# Learned lexicon: entries at most, documents an entry needs, and the log
# odds (in favour of toxic) it needs.
MAX_ENTRIES = 400
MAX_CANDIDATES = 20_000
MIN_DOCS = 4
MIN_LOG_ODDS = 2.0
PREFIXES = (4, 5, 6)
NEAR = 5
TREES = 20
DEPTH = 4
SEED = 3

# Fixed word lists: insults of the four languages, and second-person words.
INSULTS = frozenset("""idiot idiots moron morons stupid dumb loser losers trash scum worthless pathetic disgusting clown fool
garbage filth ugly hate kill bastard bitch asshole fuck fucking shit crap damn retard imbecile pig vermin
idiota imbécil estúpido estúpida basura asco puta mierda cabrón tonto
idiote imbécile stupide salaud connard merde ordure pourriture crétin débile
dummkopf trottel arschloch scheiße abschaum versager schwein widerlich blöd hurensohn""".split())
SECOND_PERSON = frozenset("""you your yours yourself yourselves u ur tu te ti tus usted ustedes vosotros toi ton ta tes vous votre vos
du dich dir dein deine deiner deinen ihr euch euer eure""".split())
_LEET = str.maketrans("01345789@$!+", "oieastbgasit")
_MIXED = re.compile(r"(?i)[a-z][0-9@$!*+][a-z0-9@$!*+]*[a-z]|\b(?:[a-z][.\-_*]){2,}[a-z]\b")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())

FEATURES = ["insults", "learned", "prefixes", "learned_hits", "learned_kinds", "learned_weight", "near_second", "second_person",
            "capitals", "caps_words", "exclaims", "questions", "punctuation", "symbols", "digits", "obfuscated", "leet_hits",
            "log_words", "word_length", "repeats"]


def _tokens(text: str) -> list[str]:
    return [w.strip(_EDGE) or w for w in text.lower().split()]


def entries_of(word: str) -> Iterator[str]:
    """Lexicon entries a word matches: itself, and its beginnings ('abcd*')."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one text; rates are per word or character."""
    text = text or ""
    words = _tokens(text)
    n = max(1, len(words))
    starts = features.starts(lexicon)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    hits, insults, exact, begun, weight = [], 0, 0, 0, 0.0
    kinds = set()
    for i, w in enumerate(words):
        known = w in INSULTS
        insults += known
        if known:
            hits.append(i)
        if w[:PREFIXES[0]] in starts:
            found = [e for e in entries_of(w) if e in lexicon]
            if found:
                best = max(lexicon[e] for e in found)
                exact += w in lexicon
                begun += any(e[-1] == "*" for e in found)
                weight += best
                kinds.add(w)
                if not known:
                    hits.append(i)
    near = 0
    if hits and second:
        s = np.array(second)
        k = np.searchsorted(s, hits)
        h = np.array(hits)
        near = int((np.minimum(np.abs(s[np.minimum(k, len(s) - 1)] - h), np.abs(s[np.maximum(k - 1, 0)] - h)) <= NEAR).sum())
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    mixed = [m.group() for m in _MIXED.finditer(text)]
    leet = sum(m.lower().translate(_LEET).replace(".", "").replace("-", "").replace("*", "").replace("_", "") in INSULTS for m in mixed)
    found = exact + begun
    return [1000 * insults / n, 1000 * exact / n, 1000 * begun / n, math.log1p(found), float(len(kinds)), weight / math.sqrt(n),
            near / n, len(second) / n, raw[65:91].sum() / size, sum(len(w) > 1 and w.isupper() for w in text.split()) / n,
            raw[33] / size, raw[63] / size, (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / size,
            raw[[35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126]].sum() / size, raw[48:58].sum() / size, len(mixed) / n, float(leet),
            math.log1p(len(words)), sum(map(len, words)) / n, 1 - len(set(words)) / n]


def _starts(lexicon: dict[str, float]) -> frozenset:
    key = id(lexicon)
    if _starts.key != key:
        _starts.key, _starts.value = key, frozenset(e.rstrip("*")[:PREFIXES[0]] for e in lexicon)
    return _starts.value


_starts.key, _starts.value = None, frozenset()
features.starts = _starts


def training_sample(labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, label) of about ``bound`` training rows at most, chosen by a
    hash of the id. Rows without id or label are left out; repeated ids count
    once, with the largest label."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .where(crc_fold(F.col("doc_id"), folds) != held_out)
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    total = rows.count()
    if total > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * bound / total))
    return rows


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries with their log odds from a sample table (label, text).
    Candidates come from the toxic rows; then all rows are counted."""
    def kinds(text: str | None) -> set[str]:
        return {e for w in set(_tokens(text or "")) for e in entries_of(w) if len(e) < 40}

    def count(batch: pa.RecordBatch, wanted=None) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            seen.update(kinds(text) if wanted is None else kinds(text) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    def documents(rows: DataFrame, fn) -> DataFrame:
        return map_batches(rows.select("text"), fn, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    top = {r.entry: r.n for r in documents(sample.where("label = 1"), count).where(F.col("n") >= MIN_DOCS)
           .orderBy(F.desc("n"), "entry").limit(MAX_CANDIDATES).collect()}
    wanted = frozenset(top)
    clean = {r.entry: r.n for r in documents(sample.where("label = 0"), lambda b: count(b, wanted)).collect()}
    odds = {e: math.log((n + 0.5) / (bad + 1)) - math.log((clean.get(e, 0) + 0.5) / (good + 1)) for e, n in top.items()}
    best = sorted((e for e in odds if odds[e] >= MIN_LOG_ODDS), key=lambda e: (-odds[e] * math.log1p(top[e]), e))
    return {e: odds[e] for e in best[:MAX_ENTRIES]}


def feature_table(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` columns and one double column per feature."""
    kept = docs.select(*keep, "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = np.array([features(t, lexicon) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.float64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], [*keep, *FEATURES])

    schema = docs.select(*keep).schema
    for f in FEATURES:
        schema = schema.add(f, "double")
    return map_batches(kept, run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document.

    Labels are learned from the rows with crc32(doc_id) mod 5 not 0 only;
    a fifth of those calibrates. Null and empty texts are scored by their
    (zero) features; without both labels in training every score is the
    share of toxic training rows. Null ids are never trained on nor held out;
    repeated rows are scored each; extra columns are ignored.
    """
    chosen = materialize(training_sample(labels, "toxic", 5, 0, max_train), "tox-labels")
    # About max_train rows of two numbers: bounded by the parameter.
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "tox-sample")
    lexicon = learn_lexicon(sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    held = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = vectors.transform(feature_table(sample, lexicon, ["doc_id", "label"]).coalesce(4))
    train = materialize(train.select("label", "features", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("calibrates")), "tox-train")
    seen = {r.label: r["count"] for r in train.where("not calibrates").groupBy("label").count().collect()}
    out = feature_table(docs.select("doc_id", "text"), lexicon, ["doc_id"])
    if len(seen) < 2:
        share = float(seen.get(1, 0)) / max(1, sum(seen.values()))
        scored = docs.select("doc_id", F.lit(share).alias("score"))
    else:
        model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=48, seed=SEED,
                              checkpointInterval=-1).fit(train.where("not calibrates"))
        raw = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
        fitted = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(raw(train.where("calibrates")))
        # A hundredth of the raw score orders what the calibration ties.
        scored = fitted.transform(raw(vectors.transform(out))).select(
            "doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("p"))).alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
