"""Projection and filter operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import as_col
from ..functions.text import trim_ws

ALL = "All"

# The rejection messages of item validation, in check order.
REASON_BLANK_NAME = "Item name cannot be blank."
REASON_NEGATIVE_PRICE = "Price must be a non-negative number."


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project to ``cols`` in order; a missing column is an error (B1)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns that are present; absent names are ignored (B2)."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def has_column(df: DataFrame, name: str) -> bool:
    """Optional-column test made when the plan is built."""
    return name in df.columns


def drop_null(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose measure is null, e.g. section divider rows."""
    return df.where(as_col(col).isNotNull())


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter; the value ``'All'`` passes everything."""
    return df if value == ALL else df.where(as_col(col) == F.lit(value))


def filter_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """IN-list filter; null never matches and an empty list keeps nothing."""
    values = list(values)
    if not values:
        return df.where(F.lit(False))
    return df.where(as_col(col).isin(values))


def having_gt(df: DataFrame, col: str, threshold) -> DataFrame:
    """Strict ``>`` threshold on an aggregated column."""
    return df.where(as_col(col) > F.lit(threshold))


def filter_two_step(df: DataFrame, allowed: Sequence[str], column: str, value) -> DataFrame:
    """Choose a filter column among ``allowed``, then a value; ``All`` at
    either step means no filter (B9)."""
    if column == ALL or value == ALL:
        return df
    if column not in allowed:
        raise ValueError(f"{column!r} is not one of {list(allowed)}")
    return filter_eq(df, column, value)


def is_empty(df: DataFrame) -> bool:
    """Panel guard: a LIMIT 1 probe, not a count."""
    return df.isEmpty()


def validate_items(df: DataFrame, item_col: str = "Item", price_col: str | None = "Estimated Price",
                   reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, rejected) by the ordered checks of B12.

    A blank name is checked first, then a negative price; a null price is
    accepted. ``price_col=None`` (or an absent column) skips the price check.
    """
    blank = F.length(trim_ws(F.coalesce(as_col(item_col), F.lit("")))) == 0
    reason = F.when(blank, F.lit(REASON_BLANK_NAME))
    if price_col is not None and price_col in df.columns:
        price = F.col(f"`{price_col}`")
        reason = reason.when(price.isNotNull() & (price < 0), F.lit(REASON_NEGATIVE_PRICE))
    tagged = df.withColumn(reason_col, reason)
    accepted = tagged.where(F.col(reason_col).isNull()).drop(reason_col)
    rejected = tagged.where(F.col(reason_col).isNotNull())
    return accepted, rejected
