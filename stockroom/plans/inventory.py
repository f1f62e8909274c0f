"""Inventory pipelines: summary by combined section (P8), report (P9),
maintenance with snapshots (P10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.categories import DEFAULT_SECTION_GROUPS, combine_sections
from ..operators.aggregate import group_total, group_value, share_of_total
from ..operators.changes import apply_quantity_events, upsert_with_rejects
from ..operators.filters import drop_null, filter_eq, filter_in, having_gt
from ..sources.sinks import update_snapshot, write_snapshot

# Fixed value: the message when the price measure is asked for without a
# price column.
PRICE_NOT_AVAILABLE = "The 'Estimated Price' data is not available."


# Digits of the shares that the reports show.
SHARE_DIGITS = 6


def with_combined_section(df: DataFrame, groups=DEFAULT_SECTION_GROUPS) -> DataFrame:
    if "Combined_Section" in df.columns:
        return df
    return df.withColumn("Combined_Section", combine_sections(F.col("Section"), groups))


def inventory_summary(df: DataFrame, sections: Sequence[str] | None = None, measure: str = "quantity",
                      groups=DEFAULT_SECTION_GROUPS) -> DataFrame:
    """Total quantity (or value) per combined section over the chosen
    combined sections (all when ``None``), largest first."""
    out = with_combined_section(df, groups)
    if sections is not None:
        out = filter_in(out, "Combined_Section", sections)
    if measure == "quantity":
        agg = group_total(out, "Combined_Section", "Quantity", "Total_Quantity")
        return agg.orderBy(F.desc("Total_Quantity"), F.asc("Combined_Section"))
    if "Estimated Price" not in df.columns:
        raise ValueError(PRICE_NOT_AVAILABLE)
    agg = group_value(out, "Combined_Section", "Quantity", "`Estimated Price`", "Total_Price")
    return agg.orderBy(F.desc("Total_Price"), F.asc("Combined_Section"))


def section_report(df: DataFrame, threshold=10, drill_section: str = "Laptops",
                   groups=DEFAULT_SECTION_GROUPS) -> dict[str, DataFrame]:
    """The report tables: quantity by section (dividers dropped), the
    sections over ``threshold``, one section's items, and the roll-up by
    combined section with shares."""
    rows = drop_null(df, "Quantity")
    by_section = group_total(rows, "Section", "Quantity", "Total_Quantity")
    top = having_gt(by_section, "Total_Quantity", threshold)
    drill = filter_eq(rows, "Section", drill_section).select("Item", "Quantity").orderBy(F.desc("Quantity"))
    combined = share_of_total(group_total(with_combined_section(rows, groups), "Combined_Section",
                                          "Quantity", "Total_Quantity"), "Total_Quantity", digits=SHARE_DIGITS)
    return {"by_section": by_section.orderBy(F.desc("Total_Quantity")), "top_sections": top,
            "drill_down": drill, "combined": combined}


def maintain_inventory(spark: SparkSession, root: str, name: str, incoming: DataFrame | None = None,
                       events: DataFrame | None = None) -> int:
    """P10: merge incoming items (I1) into the newest state, apply quantity
    events (I5), write the next version. Returns it. Events that streams
    added since the last version are part of that state. Incoming rows that
    validation rejects are kept, with their reason, as the snapshot table
    ``<name>_rejected``, written before the version."""
    def change(current: DataFrame) -> DataFrame:
        if incoming is not None:
            current, rejected = upsert_with_rejects(current, incoming)
            write_snapshot(rejected, root, f"{name}_rejected")
        return current if events is None else apply_quantity_events(current, events)

    return update_snapshot(spark, root, name, change)
