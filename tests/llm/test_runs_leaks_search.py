"""Periodic runs, winnowing and ranked search against brute force and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from stockroom.llm import periodic_runs, queries, ranked_search, slices, winnowing

DOCS = "doc_id long, text string, n_words string, items string, runs int, score string, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return FOLDED.findall((text or "").translate(UPPER))


def test_folded_words_and_pieces():
    for text in ["", "Ab-c9 ÄÖ\x85x\xa0y İK", "a\x1cb_c`d{e", "é1é"]:
        assert [w.decode() for w in slices.folded_words(text.encode())] == folded(text)
    raw = b"one two\tthree \n four" * 50
    assert b"".join(slices.pieces(raw, 16)) == raw
    assert [w for p in slices.pieces(raw, 16) for w in p.split()] == raw.split()


# ---- periodic runs

def _runs(t, exponent, least):
    out, n = {}, len(t)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_catchers_whole_and_word_by_word():
    rng = random.Random(11)
    for _ in range(500):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 6])
        t = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            p, s = rng.randint(1, max(1, n // 3)), rng.randrange(n)
            t = t[:s] + [t[min(n - 1, s + (i - s) % p)] for i in range(s, n)]
        for exponent, least in ((2, 0), (4, 6), (3, rng.randint(0, 30))):
            whole, online = (periodic_runs.SquareCatchers(exponent, least) for _ in range(2))
            whole.append(np.array(t, dtype=np.int64))
            k = 0
            while k < n:
                step = rng.choice([1, 1, 3, 17])
                online.append(np.array(t[k:k + step], dtype=np.int64))
                k += step
            assert whole.runs() == online.runs() == _runs(t, exponent, least)


def test_catchers_report_while_words_arrive():
    t = [0, 1, 2] * 6 + [5, 5, 5, 5, 5, 5, 5, 1, 1]
    online = periodic_runs.SquareCatchers(2, 0)
    for k, w in enumerate(t):
        online.append(np.array([w]))
        assert online.runs() == _runs(t[:k + 1], 2, 0)


def test_long_and_highly_periodic_texts():
    for t in (np.zeros(50_000, int), np.arange(50_000) % 7, np.tile(np.r_[np.zeros(100, int), 1], 200)):
        catchers = periodic_runs.SquareCatchers(4, 6)
        catchers.append(t)
        want = {50_000: 1, 20_200: 201}[len(t)]
        assert len(catchers.runs()) == want
    long_period = np.tile(np.random.default_rng(1).integers(0, 50, 9_000), 5)
    catchers = periodic_runs.SquareCatchers(4, 6)
    catchers.append(long_period)
    assert (0, 45_000, 9_000) in catchers.runs()


def _planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def _texts():
    rng = random.Random(4)
    out = [" ".join(rng.choice("ab cd e".split()) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return out + ["a a a a a a", "a\tb\na\x0bb  a b\x0ca b", "x " * 40_000, " \n ", "é é é é é é é", "a\x85b a\x85b a\x85b a\x85b a\x85b"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "clash", "clash", 1, "clash", 2) for i, t in enumerate(_texts())]
    rows += [(500, None, None, None, None, None, None), (501, "", None, None, None, None, None), (None, "b b b b b b b", None, None, None, None, None)]
    rows += [rows[3], rows[3], (2, rows[9][1], "other", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_repeated_runs_whole_table(spark, documents):
    keep = ["doc_id", "text", "runs", "score", "absent"]
    found = periodic_runs.repeated_runs(documents, keep)
    assert found.columns == ["doc_id", "text", "score", "n_words", "runs", "collapsed"]
    got = found.collect()
    assert len(got) == documents.count()
    for r in got:
        w = WORD.findall(r.text or "")
        runs = _runs(w, 4, 6) if len(w) < 10_000 else [(0, len(w), 1)]
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
    empty = periodic_runs.repeated_runs(documents.limit(0))
    assert empty.collect() == [] and empty.schema == periodic_runs.repeated_runs(documents).schema


def test_op11_query(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in documents.collect():
        w = _planted(r.doc_id, r.text)
        runs = _runs(w, 4, 6) if len(w) < 10_000 else [(0, len(w), 1)]
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- winnowing

def _leaks(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = folded(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add("" if item is None else str(item))
    sizes = sorted({len(x) for x in wins})
    for text in docs:
        w = folded(text)
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    named |= wins[tuple(w[k:k + n])]
        yield len(w), len(hit), sorted(named)


def _leak_tables(spark, shortest):
    rng = random.Random(shortest)
    vocab = ["the", "of", "Ü", "x1", "go", "Run", "é", "7"]
    phrase = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, phrase(rng.randint(max(shortest, 10), 30))) for i in range(25)]
    items += [(100 + n, phrase(n)) for n in range(shortest, 10)] if shortest < 10 else []
    items += [(items[0][0], phrase(14)), (None, phrase(12)), (300, None), (301, "--"), (302, items[3][1])]
    docs = []
    for i in range(120):
        text = phrase(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items[:25])[1].split()
            a = rng.randrange(len(w))
            text += rng.choice([" ", "-", "\n"]) + " ".join(w[a:a + rng.randint(1, 20)]).upper().replace("Ü", "Ü") + " "
        docs.append((i, text))
    docs += [(500, None), (501, ""), (None, items[1][1]), docs[5], docs[5], (502, ("the " * 5000) + items[2][1])]
    return spark.createDataFrame([(*d, "c", "c", 1, "c", 1) for d in docs], DOCS).repartition(4), docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("shortest", [1, 3, 6, 10])
def test_contamination_against_brute_force(spark, shortest):
    table, docs, benchmark, items = _leak_tables(spark, shortest)
    found = winnowing.contamination(table, benchmark, ["doc_id", "text", "items", "n_hit"])
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "items"]
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_hit, r.items) for r in found.collect()), key=str)
    want = sorted([(*d, *x) for d, x in zip(docs, _leaks([d[1] for d in docs], items))], key=str)
    assert got == want


def test_contamination_empty_tables(spark):
    table, docs, benchmark, _ = _leak_tables(spark, 10)
    none = winnowing.contamination(table, benchmark.limit(0))
    assert none.count() == len(docs) and none.where("n_hit > 0 or size(items) > 0").count() == 0
    assert winnowing.contamination(table.limit(0), benchmark).count() == 0


def test_every_shared_window_keeps_a_fingerprint():
    rng = random.Random(8)
    for lengths in ([10], [7, 10], [5], [3, 10], [1]):
        for gram, run, served in winnowing.families(lengths, 5):
            h = np.array([rng.randrange(1 << 63) for _ in range(300)], dtype=np.uint64)
            kept = set(winnowing.winnowed(h, np.zeros(300, dtype=np.int64), gram, run)[1].tolist())
            for n in served:
                for k in range(300 - n + 1):
                    assert kept & set(winnowing.gram_values(h[k:k + n], gram).tolist())
            if gram == 5 and run == 6:
                assert len(kept) < 130  # about 2 of 7


# ---- ranked search

def _ranked(docs, items, top=10):
    terms = [(d, folded(t)) for d, t in docs]
    some = [(d, w) for d, w in terms if w]
    n_docs, n_terms = len(some), sum(len(w) for _, w in some)
    df = Counter(t for _, w in some for t in set(w))
    queries_ = {}
    for item, text in items:
        queries_.setdefault(item, set()).update(folded(text))
    out = []
    for item, query in queries_.items():
        scored = []
        for d, w in some:
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            tf = Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m))
                    for t in query if tf[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def _search_tables(spark):
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(40)] + ["Ärger", "THE", "7"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(300)]
    docs += [(400 + k, docs[7][1]) for k in range(15)] + [(600, None), (601, " - "), (None, docs[7][1]), docs[9], docs[9], (602, "w1 " * 3000 + "w39")]
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(3, "w38 w37"), (None, "w5 w6"), (50, None), (51, "nowhere"), (52, docs[7][1])]
    return docs, items, spark.createDataFrame([(*d, "c", "c", 1, "c", 1) for d in docs], DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_search_against_brute_force(spark):
    docs, items, table, benchmark = _search_tables(spark)
    want = sorted(_ranked(docs, items), key=str)
    for pairs in (200_000, 40):
        got = ranked_search.search(table, benchmark, block_pairs=pairs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_search_empty_tables(spark):
    _, _, table, benchmark = _search_tables(spark)
    full = ranked_search.search(table, benchmark).schema
    for d, b in ((table.limit(0), benchmark), (table, benchmark.limit(0)), (table.where("doc_id = 600"), benchmark)):
        empty = ranked_search.search(d, b)
        assert empty.collect() == [] and [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in full]


def test_bounds_are_never_below_scores_and_rescoring_stops_early():
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(200)}".encode() for _ in range(rng.randint(1, 60))] for _ in range(200)]
    rows = [(q, f"w{rng.randrange(200)}", rng.randint(1, 50)) for q in range(12) for _ in range(6)]
    block = ranked_search.QueryBlock(sorted(set(rows), key=lambda r: (r[0], r[1])), 200, sum(map(len, texts)))
    counts = [Counter(t) for t in texts]
    factors = [ranked_search.length_factor(c.total(), 200, block.n_terms) for c in counts]
    for docs, sketch in ranked_search.sketches(counts, factors, slices.WordHashes()):
        bounds = block.bounds(sketch)
        for q in range(len(block.items)):
            for k, d in enumerate(docs.tolist()):
                assert bounds[q, k] >= block.score(q, counts[d], factors[d])
    scored = []
    best = ranked_search.Best(block, 10)
    plain = block.score
    block.score = lambda *a: scored.append(1) or plain(*a)
    for k in range(0, 200, 20):
        best.take(list(range(k, k + 20)), counts[k:k + 20], slices.WordHashes())
    assert len(scored) < 0.8 * 200 * len(block.items)
