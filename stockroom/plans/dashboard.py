"""Dashboard tables: cleaning (P4), summary cards and breakdowns (P5),
county map tables (P6), explore and export (P7)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.categories import DEFAULT_COUNTY_OF_LOCATION, YES_NO_LABELS, map_or_self, map_values
from ..functions.money import annualise, format_money, line_value, parse_money_column
from ..operators.aggregate import group_count, group_total, rollup_to, share_of_total, summary_totals
from ..operators.filters import ALL, drop_columns, filter_eq, filter_two_step
from ..operators.joins import complete_domain
from ..session import write_once
from ..sources.readers import load_table
from ..sources.sinks import export_view

# The workstation filter columns offered by the explorer.
WORKSTATION_FILTERS = ["Department", "Device", "Warehouse"]


# Digits of the shares that the charts show.
SHARE_DIGITS = 6


def clean_table(df: DataFrame) -> DataFrame:
    """Whichever table it is, drop RowID, parse money columns, add the
    derived Annual Phone Bill / Total Value (each only if its inputs exist)."""
    out = drop_columns(df, "RowID")
    if "Total Charges" in out.columns:
        out = out.withColumn("Total Charges", parse_money_column(out, "Total Charges"))
        out = out.withColumn("Annual Phone Bill", annualise(F.col("`Total Charges`")))
    if "Estimated Price" in out.columns:
        out = out.withColumn("Estimated Price", parse_money_column(out, "Estimated Price"))
        if "Quantity" in out.columns:
            out = out.withColumn("Total Value", line_value(F.col("Quantity"), F.col("`Estimated Price`")))
    return out


def summary_cards(storage: DataFrame | None, phones: DataFrame | None, workstations: DataFrame | None) -> DataFrame:
    """The four headline totals over cleaned tables, with display text.
    A missing or empty table contributes no card."""
    tables = {}
    if storage is not None and "Total Value" in storage.columns:
        tables["Total Storage Value"] = (storage, "Total Value")
    if phones is not None:
        tables["Total Phone Value"] = (phones, "Estimated Price")
        tables["Total Annual Phone Bills"] = (phones, "Annual Phone Bill")
    if workstations is not None:
        tables["Total Workstation Device Value"] = (workstations, "Estimated Price")
    return summary_totals(tables).withColumn("display", format_money(F.col("value")))


def storage_by_category(storage: DataFrame) -> DataFrame:
    return share_of_total(group_total(storage, "Combined_Section", "Total Value", "Total Value",
                                      drop_null_keys=True, money=True), "Total Value", digits=SHARE_DIGITS)


def phone_bill_by_location(phones: DataFrame) -> DataFrame:
    """Pie over raw rows: blank and null locations stay as their own slice."""
    return share_of_total(group_total(phones, "Location", "Annual Phone Bill", "Annual Phone Bill",
                                      drop_null_keys=False, money=True), "Annual Phone Bill", digits=SHARE_DIGITS)


def phone_bill_by_administration(phones: DataFrame, labels: Mapping[str, str] = YES_NO_LABELS) -> DataFrame:
    """Y/N -> Yes/No, then a pandas group-by: rows with neither flag vanish."""
    labelled = phones.withColumn("Administration", map_values(F.col("Administration"), labels))
    return share_of_total(group_total(labelled, "Administration", "Annual Phone Bill", "Annual Phone Bill",
                                      drop_null_keys=True, money=True), "Annual Phone Bill", digits=SHARE_DIGITS)


def workstation_value_by(workstations: DataFrame, key: str) -> DataFrame:
    """Device / Warehouse / Department value breakdown with shares."""
    return share_of_total(group_total(workstations, key, "Estimated Price", "Estimated Price",
                                      drop_null_keys=True, money=True), "Estimated Price", digits=SHARE_DIGITS)


def county_table(df: DataFrame, domain: DataFrame, value_col: str | None = None,
                 mapping: Mapping[str, str] = DEFAULT_COUNTY_OF_LOCATION, name: str | None = None,
                 default=0) -> DataFrame:
    """Per-location count or sum -> county (C12) -> re-aggregate
    -> every county of the domain, missing -> ``default`` (J2).

    Aggregating before the join keeps the join at one row per location.
    """
    loc = "Location" if "Location" in df.columns else "Warehouse"
    if value_col is None:
        name = name or "Number of Phones"
        per_loc = group_count(df, loc, name)
        county = rollup_to(per_loc, map_or_self(F.col(f"`{loc}`"), mapping), name, "County")
    else:
        name = name or value_col
        per_loc = group_total(df, loc, value_col, name, drop_null_keys=True, money=True)
        county = rollup_to(per_loc, map_or_self(F.col(f"`{loc}`"), mapping), name, "County", money=True)
    return complete_domain(domain, county, "County", name, default)


def explore(df: DataFrame, column: str, value) -> DataFrame:
    """P7 single-step filter with the 'All' pass-through."""
    return filter_eq(df, column, value)


def explore_workstations(df: DataFrame, column: str = ALL, value=ALL) -> DataFrame:
    return filter_two_step(df, WORKSTATION_FILTERS, column, value)


def export_explored(df: DataFrame, root: str, kind: str, label: str = ALL, category: str | None = None) -> str:
    return export_view(df, root, kind, label=label, category=category)


def load_dashboard(spark, root: str, names: Mapping[str, str], schemas: Mapping[str, StructType]) -> dict:
    """P4 for the dashboard: load each named table snapshot (a missing one
    is an empty table of its schema, A4), clean it, and write it once: every
    panel below reads its columns of that copy, nothing stays cached."""
    return {role: write_once(clean_table(load_table(spark, root, name, schemas[role])), f"dashboard-{role}")
            for role, name in names.items()}


def dashboard_tables(tables: Mapping[str, DataFrame], domain: DataFrame,
                     mapping: Mapping[str, str] = DEFAULT_COUNTY_OF_LOCATION) -> dict[str, DataFrame]:
    """The summary cards, the breakdowns with shares, and the
    county tables, from cleaned ``storage``, ``phones`` and ``workstations``
    tables (any may be absent)."""
    storage, phones, ws = tables.get("storage"), tables.get("phones"), tables.get("workstations")
    out = {"cards": summary_cards(storage, phones, ws)}
    if storage is not None and "Total Value" in storage.columns:
        out["storage_by_category"] = storage_by_category(storage)
    if phones is not None:
        out["phone_bill_by_location"] = phone_bill_by_location(phones)
        out["phone_bill_by_administration"] = phone_bill_by_administration(phones)
        out["county_phone_count"] = county_table(phones, domain, None, mapping)
        out["county_annual_bill"] = county_table(phones, domain, "Annual Phone Bill", mapping)
        out["county_phone_value"] = county_table(phones, domain, "Estimated Price", mapping)
    if ws is not None:
        for key in WORKSTATION_FILTERS:
            out[f"workstation_value_by_{key.lower()}"] = workstation_value_by(ws, key)
        out["county_workstation_value"] = county_table(ws, domain, "Estimated Price", mapping)
    return out
