"""Quality rules with adaptive thresholds, all in DataFrame functions.

Per document, counts over the whole text. Per (language, source) a mergeable
quantile sketch of every rate: a histogram over log-linear buckets (the
bucket keeps the value's leading six bits, so quantiles are exact to one
part in 32) whose merge is the sum of counts. Groups with few documents use
the merged sketch of their language, then that of all documents. A
threshold is an outer fence of the group's sketch, never below a floor.
Documents are joined to their group's thresholds and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.llm.common import WORD_SPACES, materialize, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A group's sketch needs so many documents; below, the wider one counts.
MIN_GROUP = 50
# Fence: the median plus so many spreads between the median and the 75th percentile.
SPREADS = 16
KEEP_BITS = 6
# Rates that are judged, in parts per thousand, with the floor below which
# no fence may fall: a guard for groups without spread. Repeats above the base
# rule are gone before, so that their floor lies below it.
RATES = {"symbol_rate": 50, "dup_line_rate": 400, "repeat_rate": 290, "upper_rate": 20, "word_length": 6000}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: inside a lambda
    a plain expression would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(word_hashes: Column, n: Column) -> Column:
    """Hashes of all WINDOW-word windows: neighbours are combined at
    distances 1, 2 and 4."""
    def pair_up(step: int):
        return lambda a: F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a), F.lit(1))),
                                    lambda x, y: F.xxhash64(x, y))

    h = word_hashes
    for step in (1, 2, 4):
        h = _let(h, pair_up(step))
    return F.slice(h, F.lit(1), F.greatest(n.cast("int") - (WINDOW - 1), F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more. Sorted (hash, position)
    pairs put equal windows side by side; the union of the flagged windows is
    summed over the gaps of their positions."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    flagged = _let(pairs, lambda p: F.filter(p, lambda x, k: (
        ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))))
    pos = F.sort_array(F.transform(flagged, lambda x: x["i"]))
    gaps = _let(pos, lambda q: F.zip_with(q, F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(1))),
                                          lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_upper, n_lines (long). Null texts have no words.
    Windows are compared by the hash chain of their words (64 bits)."""
    # Arrays that are used more than once are columns of their own, so that
    # they are computed once and their uses run in generated code.
    d = docs.withColumn("__t", F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("__w", words(F.col("__t")))
    d = d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "__bare": F.array_join("__w", ""),
        "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "__win": F.when(F.size("__w") > WINDOW, _window_hashes(F.transform("__w", lambda w: F.xxhash64(w)), F.size("__w")))})
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": F.length("__bare").cast("long"),
        "n_symbols": (F.length("__bare") - F.length(F.translate("__bare", SYMBOLS, ""))).cast("long"),
        "n_upper": F.length(F.regexp_replace("__bare", "[^A-Z]+", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__win").isNull() | (F.size(F.array_distinct("__win")) == F.size("__win")),
                                 F.lit(0).cast("long")).otherwise(_covered(F.col("__win"))),
    }
    # A generator of one row: the planner does not fold the counts into the
    # expressions that use them, which would count again for every use.
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in counts.items()]))))


def _rates(m: DataFrame) -> DataFrame:
    per = lambda a, b: F.coalesce(F.expr(f"try_divide({a} * 1000, {b})"), F.lit(0)).cast("long")
    return m.withColumns({
        "symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "word_chars"),
        "word_length": per("word_chars", "n_words")})


def bucket_floor(v: Column) -> Column:
    """Lower edge of the log-linear bucket of a non-negative long."""
    drop = F.greatest(F.length(F.bin(v)) - KEEP_BITS, F.lit(0))
    scale = F.pow(F.lit(2.0), drop.cast("double")).cast("long")
    return v - F.pmod(v, scale)


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rate, edge, n): the mergeable sketch of each group.
    Rows of base-failed documents are left out: they are gone anyway."""
    long = rates.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), bucket_floor(F.col(r)).alias("edge")) for r in RATES])).alias("x"))
    return long.groupBy("lang", "source", F.col("x.rate").alias("rate"), F.col("x.edge").alias("edge")).agg(
        F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Fence per key and rate from (merged) sketches, with the documents seen."""
    merged = sketch.groupBy(*keys, "rate", "edge").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    ranked = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("edge")))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("edge")))
    floors = F.create_map(*[x for r, f in RATES.items() for x in (F.lit(r), F.lit(f).cast("long"))])
    return (ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), q(50).alias("q50"), q(75).alias("q75"))
            .select(*keys, "rate", "total",
                    F.greatest(F.col("q50") + SPREADS * (F.col("q75") - F.col("q50")), floors[F.col("rate")]).alias("fence")))


def _wide(fences: DataFrame, keys: list[str], name: str) -> DataFrame:
    pick = lambda r: F.max(F.when(F.col("rate") == r, F.col("fence")))
    return fences.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in keys]).agg(
        F.max("total").alias(f"{name}_total"), F.struct(*[pick(r).alias(r) for r in RATES]).alias(name))


def thresholds(rates: DataFrame) -> DataFrame:
    """One row per (lang, source): th_lang, th_source, th (a struct with the
    fence of every rate), from the narrowest sketch with enough documents."""
    sketch = materialize(sketches(rates), "quality-sketch")
    own, by_lang = _wide(_fences(sketch, ["lang", "source"]), ["lang", "source"], "g"), _wide(_fences(sketch, ["lang"]), ["lang"], "l")
    # The sketch of everything gives one fence per rate: five numbers.
    total = {r.rate: r.fence for r in _fences(sketch, []).collect()}
    everything = F.struct(*[F.lit(total.get(r)).cast("long").alias(r) for r in RATES])
    return own.join(by_lang, own.g_lang.eqNullSafe(by_lang.l_lang), "left").select(
        F.col("g_lang").alias("th_lang"), F.col("g_source").alias("th_source"),
        F.when(F.col("g_total") >= MIN_GROUP, F.col("g")).when(F.col("l_total") >= MIN_GROUP, F.col("l"))
        .otherwise(everything).alias("th"))


def with_base(metrics: DataFrame) -> DataFrame:
    return _rates(metrics).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def verdicts(rates: DataFrame, th: DataFrame) -> DataFrame:
    """``rates`` (see ``with_base``) with column kept: false if the base rules
    failed, else true if no rate lies above its fence. Groups are matched
    null-safely; rates of a group without any fence are kept."""
    j = rates.join(th, rates.lang.eqNullSafe(th.th_lang) & rates.source.eqNullSafe(th.th_source), "left")
    above = F.lit(False)
    for r in RATES:
        above = above | F.coalesce(F.col(r) > F.col("th")[r], F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~above).drop("th_lang", "th_source", "th")


def quality_table(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, kept) per document.

    Null texts and texts without words fail the base rules; null languages
    and sources are groups of their own; repeated rows are judged alike;
    empty input gives no rows. Texts are read once: the counts are written,
    then sketched and joined."""
    m = materialize(text_metrics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-metrics")
    rates = with_base(m)
    return verdicts(rates, materialize(thresholds(rates), "quality-thresholds"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with their own columns. Counts are taken
    twice, so that no text is shuffled."""
    slim = text_metrics(docs.select("lang", "source", "text")).drop("text")
    th = materialize(thresholds(with_base(slim)), "quality-thresholds")
    full = text_metrics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "lang", "source", "text"))
    return verdicts(with_base(full), th).where("kept").select("__row.*")
