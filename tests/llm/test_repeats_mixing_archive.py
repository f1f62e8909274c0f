"""Copies that very many rows hold, ids of other types, clashing columns; budgets spent; records rebuilt at size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stockroom.llm import common, mixing, suffix_dedup, warc

LENGTH = suffix_dedup.LENGTH


def brute_repeats(rows):
    """{position in rows: (n_bytes, removed, spans, sha256)}; rows are (id or None, text)."""
    order = lambda i: (i is None, i if i is not None else 0)
    least = {}
    raws = [(t or "").encode() for _, t in rows]
    for (i, _), raw in zip(rows, raws):
        for p in range(len(raw) - LENGTH + 1):
            w = raw[p:p + LENGTH]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for (i, _), raw in zip(rows, raws):
        hit = bytearray(len(raw))
        for p in range(len(raw) - LENGTH + 1):
            if least[raw[p:p + LENGTH]] < order(i):
                hit[p:p + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        out.append((len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _texts(n):
    passage = "a passage that several of the texts hold, word for word, and long enough to be removed from them. "
    return [(passage if k % 5 == 0 else "") + " ".join(f"w{(k * 31 + j * j) % 97}x{j}" for j in range(12 + k % 9)) + (passage if k % 7 == 0 else "")
            for k in range(n)]


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_ids_of_any_type_and_clashing_columns(spark, kind):
    texts = _texts(60)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (None, texts[10]), (61, texts[5]), (3, texts[5]), (62, None), (63, "short")]
    name = {"long": lambda k: k, "string": lambda k: f"id{k:03d}", "date": lambda k: f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}"}[kind]
    docs = spark.createDataFrame([(None if i is None else name(i), t, 7, "x", i) for i, t in rows],
                                 f"doc_id {'string' if kind == 'date' else kind}, text string, n_bytes int, kept_sha256 string, own long")
    if kind == "date":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("date"))
    got = suffix_dedup.remove_repeats(docs.repartition(3), ["doc_id", "own", "n_bytes", "kept_sha256"])
    assert got.columns == ["doc_id", "own", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted([(i, *x) for (i, _), x in zip(rows, brute_repeats(rows))], key=str)
    assert sorted(((r.own, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == want


def test_one_text_in_a_third_of_the_rows(spark):
    """100,000 rows, a third of them one text: they are settled without being gathered."""
    hot = "one text that a third of all the rows hold, exactly as it stands here, from its start to its end"
    docs = spark.range(100_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 1, F.lit(hot)).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    out = suffix_dedup.remove_repeats(docs, with_text=True)
    facts = out.groupBy((F.col("doc_id") % 3 == 1).alias("hot")).agg(
        F.count("*").alias("n"), F.sum("n_removed").alias("gone"), F.max("n_spans").alias("spans"), F.sum(F.length("text")).alias("left"))
    assert sorted(tuple(r) for r in facts.collect()) == [(False, 66_667, 0, 0, sum(12 + len(str(i)) for i in range(100_000) if i % 3 != 1)),
                                                         (True, 33_333, 33_332 * len(hot), 1, len(hot))]


def test_no_session_setting_is_changed(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(_texts(20))], "doc_id long, text string")
    suffix_dedup.remove_repeats(docs).count()
    common.map_batches(docs, lambda b: iter([b]), docs.schema).count()
    assert spark.conf.get(key) == before


def test_pipeline_stage_with_clashing_columns_and_without_n_chars(spark):
    import corpus_pipeline

    texts = _texts(30)
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 2, "x", 3) for k, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_bytes long, n_removed long, kept_sha256 string, c0 int")
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 30
    assert {(r.n_bytes, r.n_removed, r.kept_sha256, r.c0) for r in out.collect()} == {(1, 2, "x", 3)}
    assert {r.doc_id: r.text for r in out.collect()}[0] == texts[0]


# ---- mixing

def _mix_docs(spark):
    rows = [(k, " ".join(["w"] * (40 + (k * 37) % 60)), ["en", "de", None][k % 3], f"src{k % 5}", 1) for k in range(600)]
    # One very long document in each of some leaves, wherever the seed puts it.
    rows += [(1000 + k, "long " * 3000, "de", f"src{k}", 1) for k in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("percent,epochs", [(90, 2), (50, 1), (30, 2)])
def test_what_leaves_cannot_spend_goes_to_others(spark, percent, epochs):
    docs = _mix_docs(spark)
    stats, rule = mixing.mixing_rule(docs, budget_percent=percent, max_epochs=epochs)
    total = stats.agg(F.sum("tokens")).first()[0]
    spent = rule.agg(F.sum("spent")).first()[0]
    taken = mixing.mixture(docs, budget_percent=percent, max_epochs=epochs)
    assert taken.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == spent
    budget = total * percent // 100
    assert budget * 0.995 <= spent <= budget
    assert rule.agg(F.sum(F.col("spent") + F.col("unspent"))).first()[0] <= budget
    assert taken.agg(F.max("copies")).first()[0] <= epochs


def test_siblings_come_before_other_leaves(spark):
    """The pool of a language goes to its own sources while one can use it."""
    schema = "domain string, lang string, source string, tokens decimal(38,0), whole int, upto long, spent decimal(38,0), unspent decimal(38,0), needs decimal(38,0)"
    from decimal import Decimal as D

    rule = spark.createDataFrame([
        ("d", "en", "a", D(100), 0, 1, D(50), D(9), D(30)), ("d", "en", "b", D(100), 0, 1, D(50), D(25), D(20)),
        ("d", "de", "a", D(100), 0, 1, D(50), D(3), D(2)), ("e", None, "a", D(40), 0, 1, D(30), D(30), D(10))], schema)
    got = lambda parent: sorted(tuple(map(str, r)) for r in mixing.pool_unspent(rule, parent, 1).collect())
    assert got(["domain", "lang"]) == [("d", "de", "a", "53", "0"), ("d", "en", "b", "84", "0"), ("e", "None", "a", "40", "20")]
    assert got(["domain"]) == [("d", "de", "a", "87", "0"), ("e", "None", "a", "40", "20")]
    assert got([]) == [("d", "de", "a", "100", "17")]


# ---- archive

def test_records_are_rebuilt_for_many_copies_and_small_payloads(spark):
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"),
        F.when(F.col("id") % 3 == 0, F.lit("<p>the same page everywhere</p>")).when(F.col("id") % 3 == 1, F.lit("tiny"))
        .otherwise(F.concat(F.lit("<p>page "), F.col("id"), F.lit("</p>"))).alias("html"))
    got = {r.page_id: r for r in warc.archive_report(pages, min_revisit_bytes=10).collect()}
    assert len(got) == 3000
    for i, r in got.items():
        text = ["<p>the same page everywhere</p>", "tiny", f"<p>page {i}</p>"][i % 3].encode()
        want = ("revisit", 2997) if i % 3 == 0 and i != 2997 else ("response", None)
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(text), *want)
    assert len({r.payload_digest for r in got.values()}) == 1002


def test_a_damaged_payload_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>text</p>")], "page_id long, url string, html string")
    archive = warc.write_archive(pages, f"{tmp_path}/a")
    bad = archive.payloads.select("digest", F.lit(b"other").alias("payload"))
    bad.write.parquet(f"{tmp_path}/b/payloads")
    archive.headers.write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.reconstruct(warc.Archive(spark, f"{tmp_path}/b")).collect()
