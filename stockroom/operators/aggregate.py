"""Aggregation operators.

All group-bys are plain Spark aggregates, so Spark combines partial results
on the map side before the shuffle; a hot key costs one partial row per
input partition, not a hot task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import as_col
from ..functions.money import money_product_sum, money_sum


def _key(df: DataFrame, key, drop_null_keys: bool) -> tuple[DataFrame, Column]:
    k = as_col(key)
    return (df.where(k.isNotNull()) if drop_null_keys else df), k


def _sum(value, money: bool) -> Column:
    return money_sum(value) if money else F.sum(as_col(value))


def group_total(df: DataFrame, key, value, name: str = "total", drop_null_keys: bool = False,
                money: bool = False) -> DataFrame:
    """Sum of ``value`` per key; a group whose values are all null sums to 0 (G1).

    ``drop_null_keys=True`` follows pandas (null keys vanish), False follows
    dplyr (null is a group). ``money=True`` sums exactly in decimal.
    """
    df, k = _key(df, key, drop_null_keys)
    return df.groupBy(k).agg(F.coalesce(_sum(value, money), F.lit(0)).alias(name))


def group_value(df: DataFrame, key, qty, price, name: str = "total_value",
                drop_null_keys: bool = False) -> DataFrame:
    """Sum of qty x price per key, nulls treated as 0."""
    df, k = _key(df, key, drop_null_keys)
    return df.groupBy(k).agg(F.coalesce(money_product_sum(qty, price), F.lit(0.0)).alias(name))


def group_count(df: DataFrame, key, name: str = "n", drop_null_keys: bool = True) -> DataFrame:
    """Rows per key (G3); pandas ``size()`` drops null keys by default."""
    df, k = _key(df, key, drop_null_keys)
    return df.groupBy(k).agg(F.count(F.lit(1)).alias(name))


def summary_totals(tables: Mapping[str, tuple[DataFrame, str]], money: bool = True) -> DataFrame:
    """One (metric, value) row per non-empty table (G4, with B11).

    ``tables`` maps a metric name to (table, value column). Metrics over the
    same table share one aggregate (one scan), unpivoted to rows. An empty
    table yields no row rather than 0; the emptiness test is part of the plan
    (``count > 0``), not a driver-side probe.
    """
    by_table: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    for metric, (df, value) in tables.items():
        by_table.setdefault(id(df), (df, []))[1].append((metric, value))
    parts = []
    for df, items in by_table.values():
        sums = [F.coalesce(_sum(value, money), F.lit(0)).cast("double").alias(f"_v{i}")
                for i, (_, value) in enumerate(items)]
        one = df.agg(*sums, F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 0)
        pairs = F.array(*[F.struct(F.lit(metric).alias("metric"), F.col(f"_v{i}").alias("value"))
                          for i, (metric, _) in enumerate(items)])
        parts.append(one.select(F.explode(pairs).alias("_m")).select("_m.metric", "_m.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def share_of_total(grouped: DataFrame, value: str, name: str = "share", digits: int | None = None) -> DataFrame:
    """Each group's fraction of the grand total (G10), rounded only on request.

    The total is a scalar subquery evaluated once, so no join, no global
    window and no single-task step is needed however many groups there are.
    """
    total = grouped.agg(F.sum(value)).scalar()
    share = F.col(value).cast("double") / total.cast("double")
    if digits is not None:
        share = F.round(share, digits)
    return grouped.withColumn(name, share)


def rollup_to(df: DataFrame, key_expr: Column, value: str, key_name: str, name: str | None = None,
              money: bool = False) -> DataFrame:
    """Re-aggregate after mapping keys (two cities -> one county)."""
    return df.groupBy(key_expr.alias(key_name)).agg(
        F.coalesce(_sum(value, money), F.lit(0)).alias(name or value))


def next_row_id(df: DataFrame, col: str = "RowID") -> Column:
    """max(id) + 1 as a scalar subquery column; 1 for an empty table."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)) + F.lit(1)).scalar()


def distinct_in_order(df: DataFrame, col: str, order_col: str, name: str = "first_pos") -> DataFrame:
    """Distinct values with the position where each first appears.

    Sort by ``name`` to present them in first-seen order. Null is a value.
    """
    return df.groupBy(as_col(col)).agg(F.min(order_col).alias(name))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values (G9); order by the column when displayed."""
    return df.select(as_col(col)).where(as_col(col).isNotNull()).distinct()
