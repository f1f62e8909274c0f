"""Phone pipelines: merge inventory with plans (P1), rule pricing (P2),
distinct-model pricing (P3)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import DEFAULT_PRICE_RULES, FIRST_NUMBER_DEFAULT, estimate_price
from ..functions.text import dashes_to_dots, flag_contains, split_phone
from ..operators.filters import select_columns
from ..operators.joins import left_join_nullsafe
from ..operators.lookup import enrich_distinct

# The columns of the merged phone table, in order.
MERGED_COLUMNS = [
    "Number", "Username", "Equipment Model", "Device ID", "Location", "Administration", "Storage",
    "Monthly Access Charges", "Usage Charges", "Equipment Charges",
    "Surcharges and Other Charges and Credits", "Taxes Governmental Surcharges and Fees",
    "Third Party Charges (Includes Tax)", "Total Charges",
]

# Fixed value: cost-centre keyword that marks an administration line.
ADMIN_KEYWORD = "ADMIN"


def prepare_plans(plans: DataFrame, text_col: str = "Number / User Name", cost_col: str = "Cost Center",
                  admin_keyword: str = ADMIN_KEYWORD) -> DataFrame:
    """Split number and user (C5), dots for dashes (C6), Administration Y/N."""
    number, user = split_phone(F.col(f"`{text_col}`"))
    return (plans.withColumn("Number", dashes_to_dots(number)).withColumn("User Name", user)
            .withColumn("Administration", flag_contains(F.col(f"`{cost_col}`"), admin_keyword)))


def merge_phones(inventory: DataFrame, plans: DataFrame, admin_keyword: str = ADMIN_KEYWORD,
                 inventory_number_col: str = "Mobile Number", null_safe: bool = True,
                 extra_cols: Sequence[str] = (), warn_null_pairs: int | None = None) -> DataFrame:
    """Prepared plans left-joined to the phone inventory on the number.

    The Administration flag is made before the join, so a phone without a
    plan has a null flag, not 'N'. Phones matching several plan lines repeat.
    What depends on the phone alone (its price, P2) is best computed before,
    once per phone, and carried through as one of ``extra_cols``.
    ``warn_null_pairs`` counts the lines without a number on both sides first.
    """
    inv = inventory
    if inventory_number_col in inv.columns and "Number" not in inv.columns:
        inv = inv.withColumnRenamed(inventory_number_col, "Number")
    prepared = prepare_plans(plans, admin_keyword=admin_keyword)
    right = prepared.drop(*[c for c in prepared.columns if c in inv.columns and c != "Number"])
    merged = left_join_nullsafe(inv, right, "Number", null_safe=null_safe, warn_null_pairs=warn_null_pairs)
    return select_columns(merged, [*MERGED_COLUMNS, *extra_cols])


def price_phones(df: DataFrame, model_col: str = "Equipment Model", rules=DEFAULT_PRICE_RULES,
                 out_col: str = "Estimated Price") -> DataFrame:
    """Estimated price by ordered keyword rules on the cleaned model."""
    return df.withColumn(out_col, estimate_price(F.col(f"`{model_col}`"), rules).cast("double"))


def first_number_series(models: pd.Series, default: float = FIRST_NUMBER_DEFAULT) -> pd.Series:
    """Price function of P3: the first number in the model text, else
    ``default`` (what the text-model lookup effectively returns)."""
    text = models.astype("string")
    return pd.to_numeric(text.str.extract(r"(\d+)", expand=False), errors="coerce").fillna(default).astype("float64")


def price_phones_distinct(df: DataFrame, model_col: str = "Equipment Model",
                          fn: Callable[[pd.Series], pd.Series] = first_number_series,
                          out_col: str = "Estimated Price", default: float = 0.0) -> DataFrame:
    """Call ``fn`` once per distinct model and map the price back."""
    return enrich_distinct(df, model_col, out_col, fn=fn, default=default)
