"""Sheet layouts: section divider rows -> a Section column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_buckets


def flatten_sections(df: DataFrame, order_col: str, item_col: str = "Item", qty_col: str = "Quantity",
                     section_col: str = "Section", group_cols: Sequence[str] = (),
                     num_partitions: int | None = None) -> DataFrame:
    """Turn divider rows (null quantity; the item text is the section name)
    into a section column on the rows below them, then drop the dividers.

    ``order_col`` is the row position, ``group_cols`` separate files or
    sheets. A forward fill per (sheet, bucket of positions), which moves the
    rows once; each bucket of a long sheet then takes the last divider of the
    buckets before it, so one long sheet is not one task.
    """
    item, order = F.col(f"`{item_col}`"), F.col(f"`{order_col}`")
    divider = F.col(f"`{qty_col}`").isNull()
    sheet = [f"_g{i}" for i in range(max(1, len(group_cols)))]
    keyed = df.withColumns({g: F.col(f"`{c}`") for g, c in zip(sheet, group_cols)} or {sheet[0]: F.lit(0)})
    rows = with_buckets(keyed, sheet, [order_col], num_partitions)
    upto = Window.partitionBy(*sheet, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_sec", F.last(F.when(divider, item), ignorenulls=True).over(upto))
    last_div = rows.where("_split").groupBy(*sheet, "_bucket").agg(
        F.max(F.when(divider, F.struct(order.alias("o"), item.alias("i")))).alias("_d"))
    before = Window.partitionBy(*sheet).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_div.select(*[F.col(g).alias(f"{g}_c") for g in sheet], F.col("_bucket").alias("_bucket_c"),
                            F.last(F.col("_d.i"), ignorenulls=True).over(before).alias("_carry"))
    same = [F.col(g).eqNullSafe(F.col(f"{g}_c")) for g in sheet] + [F.col("_bucket") == F.col("_bucket_c")]
    # One row per bucket of a cut sheet: bounded by the number of buckets.
    out = (local.join(F.broadcast(carry), same, "left")
           .withColumn(section_col, F.coalesce(F.col("_sec"), F.col("_carry")))
           .where(~divider))
    return out.drop("_bucket", "_split", "_sec", "_carry", "_bucket_c", *sheet, *[f"{g}_c" for g in sheet])
