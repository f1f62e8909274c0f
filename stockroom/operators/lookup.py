"""Lookups computed once per distinct key."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.pricing import DEFAULT_PRICE_RULES, NO_MATCH_PRICE, clean_model
from ..session import write_once

# Functions of this package that run in Python workers (the price function
# of ``enrich_distinct``) travel by value, so executors need not have the
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


# Splits text into alternating runs of word and non-word characters.
_RUN_SPLIT = r"(?U)(?<=\W)(?=\w)|(?<=\w)(?=\W)"
_WORD_START = r"(?U)^\w"


def enrich_distinct(df: DataFrame, key: str, out_col: str, *,
                    fn: Callable[[pd.Series], pd.Series] | None = None,
                    expr: Callable[[Column], Column] | None = None,
                    table: DataFrame | None = None, table_value: str | None = None,
                    out_type: str = "double", default=0.0) -> DataFrame:
    """Compute a value once per distinct ``key`` and map it back.

    Exactly one source: ``fn`` (a pandas Series -> Series function, run
    batch-wise by ``mapInPandas`` over the distinct keys only), ``expr`` (a
    column expression), or ``table`` (an existing key -> value table with one
    row per key, like the dict it stands for). Rows whose key gets no value
    receive ``default``. A null key is a key too.
    """
    if sum(x is not None for x in (fn, expr, table)) != 1:
        raise ValueError("give exactly one of fn, expr, table")
    key_type: DataType = df.schema[key].dataType
    if table is not None:
        lookup = table.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{table_value}`").cast(out_type).alias("_v"))
    else:
        keys = df.select(F.col(f"`{key}`").alias("_k")).distinct()
        if expr is not None:
            lookup = keys.select("_k", expr(F.col("_k")).cast(out_type).alias("_v"))
        else:
            def run(batches):
                for pdf in batches:
                    yield pd.DataFrame({"_k": pdf["_k"], "_v": fn(pdf["_k"])})
            lookup = keys.mapInPandas(run, schema=f"_k {key_type.simpleString()}, _v {out_type}")
    joined = df.join(lookup, df[f"`{key}`"].eqNullSafe(lookup["_k"]), "left")
    return joined.withColumn(out_col, F.coalesce(F.col("_v"), F.lit(default).cast(out_type))).drop("_k", "_v")


def rules_frame(spark, rules: Sequence[tuple[str, float]] = DEFAULT_PRICE_RULES) -> DataFrame:
    """Ordered (keyword, price) pairs as a (priority, keyword, price) table."""
    rows = [(i, k, float(p)) for i, (k, p) in enumerate(rules)]
    return spark.createDataFrame(rows, "priority int, keyword string, price double")


def price_by_rule_table(df: DataFrame, model_col: str, rules, out_col: str = "Estimated Price",
                        clean: bool = True, default=NO_MATCH_PRICE) -> DataFrame:
    """Ordered whole-word keyword rules as an equi-join.

    Same result as ``functions.price_by_rules`` for any number of rules and
    any keywords. Each distinct model text is cut into alternating runs of
    word and other characters. A whole-word match begins and ends at a word
    boundary, that is at a border of two runs, or at an end of the text whose
    run is a word. So a keyword matches exactly when it equals the text from
    one such border to a later one. A border whose run begins no keyword is
    dropped first; from the others, spans go only as far as the longest
    keyword with that first run, and are joined to the rules by equality; the
    lowest priority wins. An empty keyword matches every text with a word in it.

    ``rules`` is a (priority, keyword, price) table, or a list of (keyword,
    price) pairs in priority order. The priced texts are written once: their
    size is known when they meet the rows, which then need not move for them.
    """
    if not isinstance(rules, DataFrame):
        rules = rules_frame(df.sparkSession, list(rules))
    r = rules.select(F.upper("keyword").alias("keyword"), "priority", F.col("price").cast("double").alias("price")
                     ).where(F.col("keyword").isNotNull())
    parts = r.select(F.split("keyword", _RUN_SPLIT).alias("_k")).where(F.col("_k")[0] != "")
    heads = parts.groupBy(F.col("_k")[0].alias("_w")).agg(F.max(F.size("_k")).alias("_reach"))
    text = F.upper(clean_model(F.col(f"`{model_col}`")) if clean else F.col(f"`{model_col}`"))
    texts = df.select(text.alias("_t")).distinct().where(F.col("_t").isNotNull())
    runs = texts.select("_t", F.split("_t", _RUN_SPLIT).alias("_run"))
    # The part of the text between its first and last word boundary.
    lead = F.col("_run")[0].rlike(_WORD_START).cast("int")
    tail = F.element_at("_run", -1).rlike(_WORD_START).cast("int")
    inner = runs.select("_t", F.slice("_run", 2 - lead, F.greatest(
        F.size("_run") - (1 - lead) - (1 - tail), F.lit(0))).alias("_run")).where(F.size("_run") > 0)
    starts = inner.select("_t", "_run", F.posexplode("_run").alias("_p", "_w")).join(heads, "_w")
    spans = starts.select("_t", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.col("_reach"), F.size("_run") - F.col("_p"))),
        lambda n: F.array_join(F.slice("_run", F.col("_p") + 1, n), ""))).alias("keyword"))
    spans = spans.unionAll(inner.select("_t", F.lit("")))
    best = write_once(spans.join(r, "keyword").groupBy("_t").agg(F.min_by("price", "priority").alias("_price")), "rule-prices")
    out = (df.withColumn("_t", text).join(best, "_t", "left")
           .withColumn(out_col, F.coalesce(F.col("_price"), F.lit(float(default)))))
    return out.drop("_t", "_price")
