"""The query catalog: every operator of SURVEY section 2 bound to the given
test tables, each as a Spark plan over whole tables plus (where SQL can say
it) the equivalent DuckDB query used as the correctness oracle.

Output columns are snake_case and aliased identically on both sides.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from . import sqlparts as S
from .dashboard import (clean_table, county_table, dashboard_tables, explore, explore_workstations, export_explored,
                        load_dashboard, phone_bill_by_administration, phone_bill_by_location, storage_by_category, summary_cards, workstation_value_by)
from .inventory import inventory_summary, maintain_inventory, section_report, with_combined_section
from .phones import MERGED_COLUMNS, merge_phones, price_phones, price_phones_distinct, prepare_plans
from ..functions.categories import combine_sections, map_values
from ..functions.money import annualise, format_money, money_product_sum, money_sum, parse_money
from ..functions.pricing import DEFAULT_PRICE_RULES, clean_model, first_number, price_by_rules
from ..functions.text import match_key, parse_event, squish
from ..operators.aggregate import (distinct_in_order, distinct_sorted, group_count, group_total, group_value,
                                   next_row_id)
from ..operators.changes import (append_and_collapse, apply_buttons, apply_quantity_events, collapse_exact,
                                 collapse_items, running_quantity, upsert_items)
from ..operators.filters import drop_null, filter_eq, filter_in, filter_two_step, having_gt, validate_items
from ..operators.joins import left_join_nullsafe, remove_rows, split_matches
from ..operators.lookup import enrich_distinct, price_by_rule_table
from ..operators.ordering import (anonymise, append_rows, first_per_key, rank_groups, sort_view, table_page,
                                  with_row_id)
from ..operators.paging import search_indexed, write_gram_index, write_paged
from ..session import default_parallelism, scratch_path
from ..sources.buckets import BucketedItems
from ..sources.layout import flatten_sections
from ..sources.readers import from_rows, read_export, read_feature_names, read_table
from ..sources.sinks import export_view, read_snapshot, write_csv, write_snapshot
from ..streaming.streams import (file_stream, run_available, stream_apply_events, stream_net_quantity,
                                 stream_summary)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GROUPS = B.TEST_SECTION_GROUPS
SELECTED = B.TEST_SELECTED_SECTIONS
ADMIN = "HIGH"  # cost-centre keyword in the test plans (their priorities)


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def snake_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def snake(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(snake_name(c)) for c in df.columns])


def _inv_cols_sql(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (f'{a}"Item" AS item, {a}"Quantity" AS quantity, {a}"Comments" AS comments, {a}"Section" AS section, '
            f'{a}"Estimated Price" AS estimated_price, {a}"RowID" AS rowid')


INV_COLS = _inv_cols_sql()

# ---------------------------------------------------------------------------
# P8 inventory summary (flagship) and category functions
# ---------------------------------------------------------------------------


@register("inventory_summary", B.with_ctes("inventory") + f"""
SELECT combined_section, CAST(sum("Quantity") AS BIGINT) AS total_quantity,
       {S.money_product_sum('"Quantity"', '"Estimated Price"')} AS total_value
FROM (SELECT *, {S.combine('"Section"', GROUPS)} AS combined_section FROM inventory)
WHERE combined_section IN ({', '.join(S.lit(s) for s in SELECTED)})
GROUP BY combined_section""")
def q_inventory_summary(spark, d):
    inv = filter_in(with_combined_section(B.inventory(spark, d), GROUPS), "Combined_Section", SELECTED)
    out = inv.groupBy(F.col("Combined_Section").alias("combined_section")).agg(
        F.coalesce(F.sum("Quantity"), F.lit(0)).alias("total_quantity"),
        F.coalesce(money_product_sum("Quantity", "`Estimated Price`"), F.lit(0.0)).alias("total_value"))
    return out.orderBy(F.desc("total_value"), "combined_section")


@register("combine_sections", B.with_ctes("inventory") + f"""
SELECT "RowID" AS rowid, "Section" AS section, {S.combine('"Section"', GROUPS)} AS combined_section
FROM inventory""")
def q_combine_sections(spark, d):
    inv = B.inventory(spark, d)
    return inv.select(F.col("RowID").alias("rowid"), F.col("Section").alias("section"),
                      combine_sections("Section", GROUPS).alias("combined_section"))


@register("normalise_text", B.with_ctes("inventory") + f"""
SELECT "RowID" AS rowid, {S.squish('"Item"')} AS item_squished, {S.key('"Item"')} AS item_key,
       {S.key('"Comments"')} AS comments_key
FROM inventory""")
def q_normalise_text(spark, d):
    inv = B.inventory(spark, d)
    return inv.select(F.col("RowID").alias("rowid"), squish("Item").alias("item_squished"),
                      match_key("Item").alias("item_key"), match_key("Comments").alias("comments_key"))


# ---------------------------------------------------------------------------
# Money, phones, pricing
# ---------------------------------------------------------------------------


@register("money_parse", B.with_ctes("plans") + f"""
SELECT plan_id, "Total Charges" AS total_charges_text, {S.parse_money('"Total Charges"')} AS total_charges,
       {S.parse_money('"Total Charges"')} * 12 AS annual_phone_bill,
       {S.money(S.parse_money('"Total Charges"'))} AS total_charges_display
FROM plans""")
def q_money_parse(spark, d):
    p = B.plans(spark, d)
    v = parse_money(F.col("`Total Charges`"))
    return p.select("plan_id", F.col("`Total Charges`").alias("total_charges_text"), v.alias("total_charges"),
                    annualise(v).alias("annual_phone_bill"), format_money(v).alias("total_charges_display"))


@register("price_rules", B.with_ctes("phones") + f"""
SELECT c_custkey, "Equipment Model" AS equipment_model,
       {S.price_rules('"Equipment Model"', DEFAULT_PRICE_RULES)} AS estimated_price
FROM phones""")
def q_price_rules(spark, d):
    ph = price_phones(B.phones(spark, d))
    return ph.select("c_custkey", F.col("`Equipment Model`").alias("equipment_model"),
                     F.col("`Estimated Price`").alias("estimated_price"))


@register("price_rule_table", ORACLES["price_rules"])
def q_price_rule_table(spark, d):
    ph = price_by_rule_table(B.phones(spark, d), "Equipment Model", DEFAULT_PRICE_RULES)
    return ph.select("c_custkey", F.col("`Equipment Model`").alias("equipment_model"),
                     F.col("`Estimated Price`").alias("estimated_price"))


# Rules over the test inventory's item names: overlapping keywords where
# order decides ('RED PLATE' before 'PLATE', 'HOT' after both).
ITEM_RULES = [("RED PLATE", 10.0), ("PLATE", 5.0), ("SMALL GEAR", 7.0), ("GEAR", 3.0), ("HOT", 2.0)]


@register("price_rule_table_items", B.with_ctes("inventory") + f"""
SELECT "RowID" AS rowid, {S.price_rules('"Item"', ITEM_RULES)} AS rule_price FROM inventory""")
def q_price_rule_table_items(spark, d):
    inv = price_by_rule_table(B.inventory(spark, d), "Item", ITEM_RULES, "rule_price")
    return inv.select(F.col("RowID").alias("rowid"), "rule_price")


@register("price_rules_items", ORACLES["price_rule_table_items"])
def q_price_rules_items(spark, d):
    inv = B.inventory(spark, d)
    return inv.select(F.col("RowID").alias("rowid"),
                      price_by_rules(clean_model(F.col("Item")), ITEM_RULES).cast("double").alias("rule_price"))


@register("price_distinct", B.with_ctes("phones") + f"""
SELECT c_custkey, "Equipment Model" AS equipment_model, {S.first_number('"Equipment Model"')} AS estimated_price
FROM phones""")
def q_price_distinct(spark, d):
    ph = price_phones_distinct(B.phones(spark, d))
    return ph.select("c_custkey", F.col("`Equipment Model`").alias("equipment_model"),
                     F.col("`Estimated Price`").alias("estimated_price"))


@register("first_number", ORACLES["price_distinct"])
def q_first_number(spark, d):
    ph = B.phones(spark, d)
    return ph.select("c_custkey", F.col("`Equipment Model`").alias("equipment_model"),
                     first_number(F.col("`Equipment Model`")).alias("estimated_price"))


_PHONE_RX = S.lit(r"(\d{3}-\d{3}-\d{4})\s*(.*)")
_PREPARED_PLANS = f"""
pp AS (
  SELECT *,
         CASE WHEN regexp_matches("Number / User Name", {_PHONE_RX})
              THEN replace(regexp_extract("Number / User Name", {_PHONE_RX}, 1), '-', '.') END AS "Number",
         CASE WHEN regexp_matches("Number / User Name", {_PHONE_RX})
              THEN regexp_extract("Number / User Name", {_PHONE_RX}, 2) END AS "User Name",
         CASE WHEN contains(upper("Cost Center"), '{ADMIN}') THEN 'Y' ELSE 'N' END AS "Administration"
  FROM plans)"""


@register("phone_split", B.with_ctes("plans", extra=_PREPARED_PLANS) + """
SELECT plan_id, "Number" AS number, "User Name" AS user_name FROM pp""")
def q_phone_split(spark, d):
    p = prepare_plans(B.plans(spark, d), admin_keyword=ADMIN)
    return p.select("plan_id", F.col("Number").alias("number"), F.col("`User Name`").alias("user_name"))


@register("admin_flag", B.with_ctes("plans", extra=_PREPARED_PLANS) + """
SELECT plan_id, "Cost Center" AS cost_center, "Administration" AS administration,
       CASE "Administration" WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' END AS administration_label
FROM pp""")
def q_admin_flag(spark, d):
    p = prepare_plans(B.plans(spark, d), admin_keyword=ADMIN)
    return p.select("plan_id", F.col("`Cost Center`").alias("cost_center"),
                    F.col("Administration").alias("administration"),
                    map_values(F.col("Administration")).alias("administration_label"))


@register("nullsafe_left_join", B.with_ctes("phones", "plans", extra=_PREPARED_PLANS) + """
SELECT p.c_custkey, p."Number" AS number, q.plan_id, q."Cost Center" AS cost_center
FROM phones p LEFT JOIN pp q ON p."Number" IS NOT DISTINCT FROM q."Number" """)
def q_nullsafe_left_join(spark, d):
    left = B.phones(spark, d).select("c_custkey", "Number")
    right = prepare_plans(B.plans(spark, d), admin_keyword=ADMIN).select("Number", "plan_id", "Cost Center")
    j = left_join_nullsafe(left, right, "Number")
    return j.select("c_custkey", F.col("Number").alias("number"), "plan_id",
                    F.col("`Cost Center`").alias("cost_center"))


_MERGED_SQL = """
merged AS (
  SELECT p."Number", p."Username", p."Equipment Model", p."Device ID", p."Location", q."Administration",
         p."Storage", q."Monthly Access Charges", q."Usage Charges", q."Equipment Charges",
         q."Surcharges and Other Charges and Credits", q."Taxes Governmental Surcharges and Fees",
         q."Third Party Charges (Includes Tax)", q."Total Charges"
  FROM phones p LEFT JOIN pp q ON p."Number" IS NOT DISTINCT FROM q."Number")"""

_MERGED_OUT = """
SELECT "Number" AS number, "Username" AS username, "Equipment Model" AS equipment_model,
       "Device ID" AS device_id, "Location" AS location, "Administration" AS administration,
       "Storage" AS storage, "Monthly Access Charges" AS monthly_access_charges,
       "Usage Charges" AS usage_charges, "Equipment Charges" AS equipment_charges,
       "Surcharges and Other Charges and Credits" AS surcharges_and_other_charges_and_credits,
       "Taxes Governmental Surcharges and Fees" AS taxes_governmental_surcharges_and_fees,
       "Third Party Charges (Includes Tax)" AS third_party_charges_includes_tax,
       "Total Charges" AS total_charges"""


@B._per_application
def _merged(spark, d) -> DataFrame:
    return merge_phones(B.phones(spark, d), B.plans(spark, d), admin_keyword=ADMIN)


@B._per_application
def _merged_prices(spark, d) -> DataFrame:
    """Priced once per phone, before the plan lines multiply the rows."""
    return merge_phones(price_phones(B.phones(spark, d)), B.plans(spark, d), admin_keyword=ADMIN,
                        extra_cols=["Estimated Price"])


@register("phone_merge", B.with_ctes("phones", "plans", extra=_PREPARED_PLANS + ",\n" + _MERGED_SQL)
          + _MERGED_OUT + " FROM merged")
def q_phone_merge(spark, d):
    return snake(_merged(spark, d))


@register("phone_prices", B.with_ctes("phones", "plans", extra=_PREPARED_PLANS + ",\n" + _MERGED_SQL)
          + _MERGED_OUT + f""",
       {S.price_rules('"Equipment Model"', DEFAULT_PRICE_RULES)} AS estimated_price FROM merged""")
def q_phone_prices(spark, d):
    return snake(_merged_prices(spark, d))


# Cleaned phone table (P4 over P1 + P2) for the dashboard queries.
_PHONES_CLEAN_SQL = _PREPARED_PLANS + ",\n" + _MERGED_SQL + f""",
phones_clean AS (
  SELECT *, {S.parse_money('"Total Charges"')} AS total_charges_num,
         {S.parse_money('"Total Charges"')} * 12 AS "Annual Phone Bill",
         {S.price_rules('"Equipment Model"', DEFAULT_PRICE_RULES)} AS "Estimated Price"
  FROM merged)"""


@B._per_application
def _phones_clean(spark, d) -> DataFrame:
    return clean_table(_merged_prices(spark, d))


_WS_CLEAN_SQL = f"""
ws_clean AS (SELECT l_orderkey, l_linenumber, "Device", "Warehouse", "Department",
                    {S.parse_money('"Estimated Price"')} AS "Estimated Price" FROM workstations)"""


@B._per_application
def _ws_clean(spark, d) -> DataFrame:
    return clean_table(B.workstations(spark, d))


# ---------------------------------------------------------------------------
# County map tables (P6: G3/G1 -> C12 -> G11 -> J2)
# ---------------------------------------------------------------------------

def _county_sql(source: str, value_sql: str, name: str, loc: str, money: bool) -> str:
    county = " ".join(f"WHEN loc = {S.lit(k)} THEN {S.lit(v)}" for k, v in B.TEST_COUNTY_OF_LOCATION.items())
    outer = S.money_sum(name) if money else f"sum({name})"
    return f"""
per_loc AS (SELECT {loc} AS loc, {value_sql} AS {name} FROM {source} WHERE {loc} IS NOT NULL GROUP BY {loc}),
per_county AS (SELECT CASE {county} ELSE loc END AS county, {outer} AS {name} FROM per_loc GROUP BY 1)"""


@register("county_phone_counts", B.with_ctes("phones", extra=_county_sql("phones", "count(*)", "n", '"Location"', False))
          + """
SELECT n_name AS county, CAST(coalesce(c.n, 0) AS BIGINT) AS number_of_phones
FROM nation LEFT JOIN per_county c ON n_name = c.county""")
def q_county_phone_counts(spark, d):
    t = county_table(B.phones(spark, d), B.county_domain(spark, d), None, B.TEST_COUNTY_OF_LOCATION)
    return snake(t)


@register("county_annual_bill", B.with_ctes("phones", "plans", extra=_PHONES_CLEAN_SQL + ","
                                            + _county_sql("phones_clean", S.money_sum('"Annual Phone Bill"'),
                                                          "v", '"Location"', True)) + """
SELECT n_name AS county, coalesce(c.v, 0) AS annual_phone_bill
FROM nation LEFT JOIN per_county c ON n_name = c.county""")
def q_county_annual_bill(spark, d):
    t = county_table(_phones_clean(spark, d), B.county_domain(spark, d), "Annual Phone Bill",
                     B.TEST_COUNTY_OF_LOCATION)
    return snake(t)


@register("county_workstation_value", B.with_ctes("workstations", extra=_WS_CLEAN_SQL + ","
                                                  + _county_sql("ws_clean", S.money_sum('"Estimated Price"'), "v",
                                                                '"Warehouse"', True)) + """
SELECT n_name AS county, coalesce(c.v, 0) AS estimated_price
FROM nation LEFT JOIN per_county c ON n_name = c.county""")
def q_county_workstation_value(spark, d):
    t = county_table(_ws_clean(spark, d), B.county_domain(spark, d), "Estimated Price", B.TEST_COUNTY_OF_LOCATION)
    return snake(t)


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------

@register("group_total", B.with_ctes("inventory") + """
SELECT "Section" AS section,
       CAST(coalesce(sum(CASE WHEN "Quantity" > 45 THEN NULL ELSE "Quantity" END), 0) AS BIGINT) AS total_quantity
FROM inventory GROUP BY "Section" """)
def q_group_total(spark, d):
    inv = B.inventory(spark, d).withColumn(
        "Quantity", F.when(F.col("Quantity") > 45, F.lit(None)).otherwise(F.col("Quantity")))
    return snake(group_total(inv, "Section", "Quantity", "total_quantity", drop_null_keys=False))


@register("group_count", B.with_ctes("phones") + """
SELECT "Location" AS location, count(*) AS n FROM phones WHERE "Location" IS NOT NULL GROUP BY "Location" """)
def q_group_count(spark, d):
    return snake(group_count(B.phones(spark, d), "Location", "n"))


@register("group_value", f"""
SELECT l_returnflag, {S.money_sum('l_quantity')} AS total_quantity,
       {S.money_product_sum('l_quantity', 'l_extendedprice')} AS total_value
FROM lineitem GROUP BY l_returnflag""")
def q_group_value(spark, d):
    li = B.table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.coalesce(money_sum("l_quantity"), F.lit(0.0)).alias("total_quantity"),
        F.coalesce(money_product_sum("l_quantity", "l_extendedprice"), F.lit(0.0)).alias("total_value"))


@register("group_value_op", f"""
SELECT l_returnflag, {S.money_product_sum('l_quantity', 'l_extendedprice')} AS total_value
FROM lineitem GROUP BY l_returnflag""")
def q_group_value_op(spark, d):
    return group_value(B.table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@register("having_gt", B.with_ctes("inventory") + """
SELECT "Item" AS item, "Section" AS section, CAST(sum("Quantity") AS BIGINT) AS total_quantity
FROM inventory WHERE "Quantity" IS NOT NULL GROUP BY "Item", "Section" HAVING sum("Quantity") > 100""")
def q_having_gt(spark, d):
    rows = drop_null(B.inventory(spark, d), "Quantity")
    g = rows.groupBy(F.col("Item").alias("item"), F.col("Section").alias("section")).agg(
        F.coalesce(F.sum("Quantity"), F.lit(0)).alias("total_quantity"))
    return having_gt(g, "total_quantity", 100)


@register("section_report", B.with_ctes("inventory") + """
SELECT "Section" AS section, CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS total_quantity
FROM inventory WHERE "Quantity" IS NOT NULL GROUP BY "Section" HAVING coalesce(sum("Quantity"), 0) > 10""")
def q_section_report(spark, d):
    return snake(section_report(B.inventory(spark, d), threshold=10, groups=GROUPS)["top_sections"])


@register("section_shares", B.with_ctes("inventory") + f"""
SELECT combined_section, total_quantity,
       round(CAST(total_quantity AS DOUBLE) / sum(total_quantity) OVER (), 6) AS share
FROM (SELECT {S.combine('"Section"', GROUPS)} AS combined_section,
             CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS total_quantity
      FROM inventory WHERE "Quantity" IS NOT NULL GROUP BY 1)""")
def q_section_shares(spark, d):
    return snake(section_report(B.inventory(spark, d), threshold=10, groups=GROUPS)["combined"])


@register("drill_down", B.with_ctes("inventory") + """
SELECT "RowID" AS rowid, "Item" AS item, "Quantity" AS quantity FROM inventory WHERE "Section" = 'LARGE'""")
def q_drill_down(spark, d):
    return filter_eq(B.inventory(spark, d), "Section", "LARGE").select(
        F.col("RowID").alias("rowid"), F.col("Item").alias("item"), F.col("Quantity").alias("quantity"))


@register("filter_in", B.with_ctes("inventory") + f"""
SELECT "RowID" AS rowid, "Item" AS item, combined_section
FROM (SELECT *, {S.combine('"Section"', GROUPS)} AS combined_section FROM inventory)
WHERE combined_section IN ({', '.join(S.lit(s) for s in SELECTED)})""")
def q_filter_in(spark, d):
    inv = filter_in(with_combined_section(B.inventory(spark, d), GROUPS), "Combined_Section", SELECTED)
    return inv.select(F.col("RowID").alias("rowid"), F.col("Item").alias("item"),
                      F.col("Combined_Section").alias("combined_section"))


@register("filter_two_step", B.with_ctes("workstations") + """
SELECT l_orderkey, l_linenumber, "Device" AS device, "Warehouse" AS warehouse, "Department" AS department,
       "Estimated Price" AS estimated_price
FROM workstations WHERE "Department" = 'Dept F'""")
def q_filter_two_step(spark, d):
    return snake(filter_two_step(B.workstations(spark, d), ["Department", "Device", "Warehouse"],
                                 "Department", "Dept F"))


@register("validate_items", B.with_ctes("incoming") + f"""
SELECT seq,
       CASE WHEN length({S.trim_ws('coalesce("Item", {0})'.format("''"))}) = 0 THEN 'Item name cannot be blank.'
            WHEN "Estimated Price" IS NOT NULL AND "Estimated Price" < 0 THEN 'Price must be a non-negative number.'
       END AS reject_reason
FROM incoming""")
def q_validate_items(spark, d):
    accepted, rejected = validate_items(B.incoming_items(spark, d))
    return (accepted.select("seq", F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(rejected.select("seq", "reject_reason")))


@register("distinct_in_order", B.with_ctes("inventory") + """
SELECT "Section" AS section, min("RowID") AS first_pos FROM inventory GROUP BY "Section" """)
def q_distinct_in_order(spark, d):
    return snake(distinct_in_order(B.inventory(spark, d), "Section", "RowID"))


@register("distinct_sorted", B.with_ctes("workstations") + """
SELECT DISTINCT "Warehouse" AS warehouse FROM workstations WHERE "Warehouse" IS NOT NULL""")
def q_distinct_sorted(spark, d):
    return snake(distinct_sorted(B.workstations(spark, d), "Warehouse")).orderBy("warehouse")


@register("next_row_id", B.with_ctes("inventory") + """
SELECT coalesce(max("RowID"), 0) + 1 AS next_row_id FROM inventory""")
def q_next_row_id(spark, d):
    return spark.range(1).select(next_row_id(B.inventory(spark, d)).alias("next_row_id"))


@register("summary_totals", B.with_ctes("inventory", "phones", "plans", "workstations",
                                        extra=_PHONES_CLEAN_SQL + ",\n" + _WS_CLEAN_SQL) + f"""
SELECT metric, value, {S.money('value')} AS display FROM (
  SELECT 'Total Storage Value' AS metric, {S.money_sum('"Quantity" * "Estimated Price"')} AS value FROM inventory
  UNION ALL SELECT 'Total Phone Value', {S.money_sum('"Estimated Price"')} FROM phones_clean
  UNION ALL SELECT 'Total Annual Phone Bills', {S.money_sum('"Annual Phone Bill"')} FROM phones_clean
  UNION ALL SELECT 'Total Workstation Device Value', {S.money_sum('"Estimated Price"')} FROM ws_clean)""")
def q_summary_totals(spark, d):
    return summary_cards(clean_table(B.inventory(spark, d)), _phones_clean(spark, d), _ws_clean(spark, d))


@register("share_of_total", B.with_ctes("workstations", extra=_WS_CLEAN_SQL) + f"""
SELECT device, estimated_price, round(estimated_price / sum(estimated_price) OVER (), 6) AS share
FROM (SELECT "Device" AS device, coalesce({S.money_sum('"Estimated Price"')}, 0) AS estimated_price
      FROM ws_clean WHERE "Device" IS NOT NULL GROUP BY "Device")""")
def q_share_of_total(spark, d):
    return snake(workstation_value_by(_ws_clean(spark, d), "Device"))


@register("storage_by_category", B.with_ctes("inventory") + f"""
SELECT combined_section, total_value, round(total_value / sum(total_value) OVER (), 6) AS share
FROM (SELECT {S.combine('"Section"', GROUPS)} AS combined_section,
             coalesce({S.money_sum('"Quantity" * "Estimated Price"')}, 0) AS total_value
      FROM inventory GROUP BY 1) WHERE combined_section IS NOT NULL""")
def q_storage_by_category(spark, d):
    storage = clean_table(with_combined_section(B.inventory(spark, d), GROUPS))
    return snake(storage_by_category(storage))


@register("phone_bill_by_location", B.with_ctes("phones", "plans", extra=_PHONES_CLEAN_SQL) + f"""
SELECT location, annual_phone_bill, round(annual_phone_bill / sum(annual_phone_bill) OVER (), 6) AS share
FROM (SELECT "Location" AS location, coalesce({S.money_sum('"Annual Phone Bill"')}, 0) AS annual_phone_bill
      FROM phones_clean GROUP BY "Location")""")
def q_phone_bill_by_location(spark, d):
    return snake(phone_bill_by_location(_phones_clean(spark, d)))


@register("admin_breakdown", B.with_ctes("phones", "plans", extra=_PHONES_CLEAN_SQL) + f"""
SELECT administration, annual_phone_bill, round(annual_phone_bill / sum(annual_phone_bill) OVER (), 6) AS share
FROM (SELECT CASE "Administration" WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' END AS administration,
             coalesce({S.money_sum('"Annual Phone Bill"')}, 0) AS annual_phone_bill
      FROM phones_clean GROUP BY 1) WHERE administration IS NOT NULL""")
def q_admin_breakdown(spark, d):
    return snake(phone_bill_by_administration(_phones_clean(spark, d)))


# ---------------------------------------------------------------------------
# Row identity, sorting, paging, unions
# ---------------------------------------------------------------------------

@register("row_id", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders""")
def q_row_id(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return with_row_id(o, ["o_orderdate", "o_orderkey"], name="row_id", unique=True).select("o_orderkey", "row_id")


@register("anonymise", B.with_ctes("phones") + """
SELECT c_custkey, 'User ' || CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR) AS username FROM phones""")
def q_anonymise(spark, d):
    ph = anonymise(B.phones(spark, d), "Username", ["c_custkey"], unique=True)
    return ph.select("c_custkey", F.col("Username").alias("username"))


@register("first_per_key", B.with_ctes("inventory") + f"""
SELECT {INV_COLS} FROM inventory QUALIFY row_number() OVER (PARTITION BY "Item" ORDER BY "RowID") = 1""")
def q_first_per_key(spark, d):
    return snake(first_per_key(B.inventory(spark, d), ["Item"], ["RowID"]))


_SEARCH = "plate"


@register("table_page", B.with_ctes("inventory") + f"""
SELECT {INV_COLS} FROM inventory
WHERE {' OR '.join(f"coalesce(contains(lower(CAST({S.q(c)} AS VARCHAR)), '{_SEARCH}'), false)"
                   for c in ["Item", "Quantity", "Comments", "Section", "Estimated Price", "RowID"])}
ORDER BY "Section" ASC NULLS LAST, "Item" ASC NULLS LAST, "RowID" ASC NULLS LAST LIMIT 10 OFFSET 10""")
def q_table_page(spark, d):
    page = table_page(B.inventory(spark, d), search=_SEARCH,
                      sort=[("Section", True), ("Item", True), ("RowID", True)], page=1, size=10)
    return snake(page)


@register("sort_view", B.with_ctes("inventory") + f"""
SELECT {INV_COLS} FROM inventory ORDER BY "Section" NULLS LAST, "Item" NULLS LAST""")
def q_sort_view(spark, d):
    return snake(sort_view(B.inventory(spark, d), tiebreak=["RowID"]))


@register("append_rows", B.with_ctes("inventory", "incoming") + """
SELECT "Item" AS item, "Quantity" AS quantity, "Comments" AS comments, "Section" AS section,
       "Estimated Price" AS estimated_price, "RowID" AS rowid, CAST(NULL AS BIGINT) AS seq FROM inventory
UNION ALL
SELECT "Item", "Quantity", "Comments", "Section", "Estimated Price", CAST(NULL AS BIGINT), seq FROM incoming""")
def q_append_rows(spark, d):
    return snake(append_rows(B.inventory(spark, d), B.incoming_items(spark, d)))


# ---------------------------------------------------------------------------
# Joins on keys
# ---------------------------------------------------------------------------

_EXISTING_INC = """
existing AS (SELECT * FROM inventory WHERE ("RowID" - 1) % 2 = 0),
inc AS (SELECT * FROM incoming WHERE seq % 2 = 1)"""


@register("split_matches", B.with_ctes("inventory", "incoming", extra=_EXISTING_INC) + f"""
SELECT i.seq, EXISTS (SELECT 1 FROM existing e WHERE {S.key('e."Item"')} = {S.key('i."Item"')}
                                               AND {S.key('e."Comments"')} = {S.key('i."Comments"')}) AS matched
FROM inc i""")
def q_split_matches(spark, d):
    existing, incoming = B.split_existing_incoming(spark, d)
    _, found, new = split_matches(existing, incoming)
    return (found.select("seq", F.lit(True).alias("matched"))
            .unionByName(new.select("seq", F.lit(False).alias("matched"))))


@register("remove_rows", B.with_ctes("inventory", "qevents") + f"""
SELECT {INV_COLS} FROM inventory WHERE "RowID" NOT IN (SELECT row_id FROM qevents WHERE delta < 0)""")
def q_remove_rows(spark, d):
    ids = B.quantity_events(spark, d).where(F.col("delta") < 0).select(F.col("row_id").alias("RowID"))
    return snake(remove_rows(B.inventory(spark, d), ids))


# ---------------------------------------------------------------------------
# Duplicate merging and upserts
# ---------------------------------------------------------------------------

@register("collapse_exact", B.with_ctes("inventory") + f"""
SELECT "Item" AS item, "Comments" AS comments, CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS quantity,
       arg_min_null("Section", "RowID") AS section, arg_min_null(combined, "RowID") AS combined_section
FROM (SELECT *, {S.combine('"Section"', GROUPS)} AS combined FROM inventory)
GROUP BY "Item", "Comments" """)
def q_collapse_exact(spark, d):
    inv = with_combined_section(B.inventory(spark, d), GROUPS)
    return snake(collapse_exact(inv, "RowID"))


@register("collapse_items", B.with_ctes("inventory") + f"""
SELECT f."Item" AS item, CAST(CASE WHEN a.nn > 0 THEN NULL ELSE a.sq END AS BIGINT) AS quantity,
       f."Comments" AS comments, f."Section" AS section, f."Estimated Price" AS estimated_price, f."RowID" AS rowid
FROM (SELECT *, {S.key('"Item"')} AS k1, {S.key('"Comments"')} AS k2 FROM inventory
      QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY "RowID") = 1) f
JOIN (SELECT {S.key('"Item"')} AS k1, {S.key('"Comments"')} AS k2, sum("Quantity") AS sq,
             count_if("Quantity" IS NULL) AS nn FROM inventory GROUP BY 1, 2) a USING (k1, k2)""")
def q_collapse_items(spark, d):
    return snake(collapse_items(B.inventory(spark, d)))


_UPSERT_SQL = _EXISTING_INC + f""",
acc AS (
  SELECT {S.squish('"Item"')} AS "Item", "Quantity", {S.squish('"Comments"')} AS "Comments", "Section",
         CAST("Estimated Price" AS DOUBLE) AS "Estimated Price", seq
  FROM inc
  WHERE NOT length({S.trim_ws('coalesce("Item", {0})'.format("''"))}) = 0
    AND NOT coalesce("Estimated Price" < 0, false)),
acck AS (SELECT *, {S.key('"Item"')} AS k1, {S.key('"Comments"')} AS k2 FROM acc),
exk AS (SELECT *, {S.key('"Item"')} AS k1, {S.key('"Comments"')} AS k2 FROM existing),
ia AS (SELECT k1, k2, min(seq) AS arr, sum("Quantity") AS iq, count_if("Quantity" IS NULL) AS inn
       FROM acck GROUP BY k1, k2),
ifirst AS (SELECT * FROM acck QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY seq) = 1),
untouched AS (SELECT "Item", "Quantity", "Comments", "Section", "Estimated Price", "RowID" FROM exk e
              WHERE NOT EXISTS (SELECT 1 FROM ia WHERE ia.k1 = e.k1 AND ia.k2 = e.k2)),
ex_agg AS (SELECT k1, k2, sum("Quantity") AS eq, count_if("Quantity" IS NULL) AS en FROM exk GROUP BY k1, k2),
efirst AS (SELECT * FROM exk QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY "RowID") = 1),
merged AS (SELECT f."Item", CASE WHEN a.en + ia.inn > 0 THEN NULL ELSE a.eq + ia.iq END AS "Quantity",
                  f."Comments", f."Section", f."Estimated Price", f."RowID"
           FROM efirst f JOIN ex_agg a USING (k1, k2) JOIN ia USING (k1, k2)),
newk AS (SELECT ia.*, row_number() OVER (ORDER BY arr) - 1 AS no FROM ia
         WHERE NOT EXISTS (SELECT 1 FROM exk e WHERE e.k1 = ia.k1 AND e.k2 = ia.k2)),
appended AS (SELECT f."Item", CASE WHEN n.inn > 0 THEN NULL ELSE n.iq END AS "Quantity", f."Comments",
                    f."Section", f."Estimated Price",
                    (SELECT coalesce(max("RowID"), 0) + 1 FROM existing) + n.no AS "RowID"
             FROM newk n JOIN ifirst f USING (k1, k2)),
upserted AS (SELECT * FROM untouched UNION ALL SELECT * FROM merged UNION ALL SELECT * FROM appended)"""


@register("upsert_items", B.with_ctes("inventory", "incoming", extra=_UPSERT_SQL) + """
SELECT "Item" AS item, CAST("Quantity" AS BIGINT) AS quantity, "Comments" AS comments, "Section" AS section,
       "Estimated Price" AS estimated_price, CAST("RowID" AS BIGINT) AS rowid FROM upserted""")
def q_upsert_items(spark, d):
    existing, incoming = B.split_existing_incoming(spark, d)
    return snake(upsert_items(existing, incoming))


@register("append_and_collapse", B.with_ctes("inventory", "incoming", extra=_EXISTING_INC) + f"""
SELECT "Item" AS item, "Comments" AS comments, CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS quantity,
       arg_min_null("Section", ord) AS section, arg_min_null(combined, ord) AS combined_section
FROM (
  SELECT "Item", "Comments", "Quantity", "Section", {S.combine('"Section"', GROUPS)} AS combined,
         ("RowID")::BIGINT AS ord FROM existing
  UNION ALL
  SELECT {S.trim_ws('"Item"')}, {S.trim_ws('"Comments"')}, "Quantity", "Section",
         {S.combine('"Section"', GROUPS)}, (10000000000000 + seq)::BIGINT FROM inc)
GROUP BY "Item", "Comments" """)
def q_append_and_collapse(spark, d):
    existing, incoming = B.split_existing_incoming(spark, d)
    return snake(append_and_collapse(existing, incoming, groups=GROUPS))


# ---------------------------------------------------------------------------
# Quantity events
# ---------------------------------------------------------------------------

@register("event_parse", """
SELECT event_id, button,
       CASE WHEN regexp_extract(button, '^(plus|minus)_(\\d+)$', 1) <> ''
            THEN TRY_CAST(regexp_extract(button, '^(plus|minus)_(\\d+)$', 2) AS BIGINT) END AS row_id,
       CASE regexp_extract(button, '^(plus|minus)_(\\d+)$', 1) WHEN 'plus' THEN 1 WHEN 'minus' THEN -1 END AS delta
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'plus_' WHEN 'error' THEN 'minus_' ELSE 'other_' END
                       || CAST(user_id AS VARCHAR) AS button FROM events)""")
def q_event_parse(spark, d):
    b = B.buttons(spark, d)
    row_id, delta = parse_event(F.col("button"))
    return b.select("event_id", "button", row_id.alias("row_id"), delta.alias("delta"))


@register("running_quantity", B.with_ctes("qevents") + """
SELECT event_id, row_id, delta,
       CAST(sum(delta) OVER (PARTITION BY row_id ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
FROM qevents""")
def q_running_quantity(spark, d):
    r = running_quantity(B.quantity_events(spark, d))
    return r.select("event_id", "row_id", "delta", "running")


_APPLY_SQL = """
r AS (SELECT row_id, delta, sum(delta) OVER (PARTITION BY row_id ORDER BY ts, event_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM qevents),
s AS (SELECT row_id, sum(delta) AS net, min(CASE WHEN delta < 0 THEN run END) AS fl FROM r GROUP BY row_id)"""

_APPLY_OUT = """
SELECT i."Item" AS item,
       CAST(CASE WHEN s.net IS NULL THEN i."Quantity" ELSE i."Quantity" + s.net END AS BIGINT) AS quantity,
       i."Comments" AS comments, i."Section" AS section, i."Estimated Price" AS estimated_price, i."RowID" AS rowid
FROM inventory i LEFT JOIN s ON i."RowID" = s.row_id
WHERE NOT coalesce(i."Quantity" + s.fl <= 0, false)"""


@register("apply_quantity_events", B.with_ctes("inventory", "qevents", extra=_APPLY_SQL) + _APPLY_OUT)
def q_apply_quantity_events(spark, d):
    return snake(apply_quantity_events(B.inventory(spark, d), B.quantity_events(spark, d)))


# ---------------------------------------------------------------------------
# Layout: divider rows -> Section column (A10)
# ---------------------------------------------------------------------------

SECTION_ORDER = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_BLOCK = 10_000_000_000


def sheet_with_dividers(spark, d) -> DataFrame:
    """The inventory laid out as a sheet: one divider row (section name,
    no quantity) above each section's rows, ``pos`` = row position."""
    p = B.table(spark, d, "part")
    secno = F.coalesce(*[F.when(F.col("p_type") == s, F.lit(i + 1)) for i, s in enumerate(SECTION_ORDER)],
                       F.lit(len(SECTION_ORDER) + 1)).cast("bigint")
    rows = p.select(F.col("p_name").alias("Item"), F.col("p_size").cast("bigint").alias("Quantity"),
                    F.col("p_brand").alias("Comments"), (secno * _BLOCK + F.col("p_partkey") + 1).alias("pos"))
    dividers = p.select("p_type").distinct().select(
        F.col("p_type").alias("Item"), F.lit(None).cast("bigint").alias("Quantity"),
        F.lit(None).cast("string").alias("Comments"),
        (F.coalesce(*[F.when(F.col("p_type") == s, F.lit(i + 1)) for i, s in enumerate(SECTION_ORDER)],
                    F.lit(len(SECTION_ORDER) + 1)).cast("bigint") * _BLOCK).alias("pos"))
    return rows.unionByName(dividers)


_SECNO_SQL = "CAST(CASE p_type " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SECTION_ORDER)) \
    + f" ELSE {len(SECTION_ORDER) + 1} END AS BIGINT)"


@register("flatten_sections", f"""
WITH layout AS (
  SELECT p_name AS "Item", CAST(p_size AS BIGINT) AS "Quantity", p_brand AS "Comments",
         {_SECNO_SQL} * {_BLOCK} + p_partkey + 1 AS pos FROM part
  UNION ALL
  SELECT p_type, NULL, NULL, {_SECNO_SQL} * {_BLOCK} FROM (SELECT DISTINCT p_type FROM part)),
filled AS (
  SELECT *, last_value(CASE WHEN "Quantity" IS NULL THEN "Item" END IGNORE NULLS)
              OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM layout)
SELECT "Item" AS item, "Quantity" AS quantity, "Comments" AS comments, pos, section
FROM filled WHERE "Quantity" IS NOT NULL""")
def q_flatten_sections(spark, d):
    flat = flatten_sections(sheet_with_dividers(spark, d), "pos")
    return flat.select(F.col("Item").alias("item"), F.col("Quantity").alias("quantity"),
                       F.col("Comments").alias("comments"), "pos", F.col("Section").alias("section"))


# ---------------------------------------------------------------------------
# CSV sink and source round trip
# ---------------------------------------------------------------------------

@register("export_round_trip", B.with_ctes("workstations", extra=_WS_CLEAN_SQL) + """
SELECT l_orderkey, l_linenumber, "Device" AS device, "Warehouse" AS warehouse, "Department" AS department,
       "Estimated Price" AS estimated_price FROM ws_clean""")
def q_export_round_trip(spark, d):
    path = scratch_path(spark, "export")
    write_csv(B.workstations(spark, d), path)
    back = read_table(spark, path, types={"l_orderkey": "bigint", "l_linenumber": "int"})
    return snake(clean_table(back))


# ---------------------------------------------------------------------------
# Streaming (T1-T3): run to completion on what is there, read the result
# ---------------------------------------------------------------------------

# Micro-batches that the event streams are cut into.
_TRIGGERS = 3


def _event_stream(spark, d, root: str) -> DataFrame:
    """The events as a folder of files, dealt by a hash of their ids: every
    file spans all times, so that micro-batches overlap in time."""
    raw = B.table(spark, d, "events").select("event_id", "ts", "event_type", "user_id")
    files = max(_TRIGGERS, default_parallelism(spark))
    raw.repartition(files, F.xxhash64("event_id")).write.parquet(f"{root}/events")
    stream = file_stream(spark, f"{root}/events", raw.schema, max_files_per_trigger=-(-files // _TRIGGERS))
    kind = (F.when(F.col("event_type") == "click", F.lit("plus_"))
            .when(F.col("event_type") == "error", F.lit("minus_")).otherwise(F.lit("other_")))
    return B.parse_buttons(stream.select("event_id", "ts", F.concat(kind, F.col("user_id").cast("string")).alias("button")))


@register("stream_net_quantity", B.with_ctes("qevents") + """
SELECT row_id, CAST(sum(delta) AS BIGINT) AS net FROM qevents GROUP BY row_id""")
def q_stream_net_quantity(spark, d):
    root = scratch_path(spark, "stream-net")
    run_available(stream_net_quantity(_event_stream(spark, d, root), root, "net", f"{root}/_checkpoint", interval=None))
    return read_snapshot(spark, root, "net")


@register("stream_summary", B.with_ctes("inventory") + f"""
SELECT {S.combine('"Section"', GROUPS)} AS combined_section, CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS total
FROM inventory GROUP BY 1""")
def q_stream_summary(spark, d):
    root = scratch_path(spark, "stream-summary")
    part_schema = B.table(spark, d, "part").schema
    raw = file_stream(spark, d, part_schema, glob="part.parquet")
    inv = raw.select(F.when(F.col("p_size") == 50, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("Section"),
                     F.col("p_size").cast("bigint").alias("Quantity"))
    inv = inv.withColumn("combined_section", combine_sections("Section", GROUPS))
    run_available(stream_summary(inv, "combined_section", "Quantity", root, "summary", f"{root}/_checkpoint",
                                 interval=None))
    return read_snapshot(spark, root, "summary")


@register("stream_apply_events", B.with_ctes("inventory", "qevents", extra=_APPLY_SQL) + _APPLY_OUT)
def q_stream_apply_events(spark, d):
    root = scratch_path(spark, "stream-apply")
    write_snapshot(B.inventory(spark, d), root, "inventory", version=0)
    run_available(stream_apply_events(_event_stream(spark, d, root), root, "inventory", f"{root}/_checkpoint",
                                      interval=None))
    return snake(read_snapshot(spark, root, "inventory"))


# ---------------------------------------------------------------------------
# Remaining dashboard and inventory views
# ---------------------------------------------------------------------------

def _ws_share_sql(key: str) -> str:
    return B.with_ctes("workstations", extra=_WS_CLEAN_SQL) + f"""
SELECT {snake_name(key)}, estimated_price, round(estimated_price / sum(estimated_price) OVER (), 6) AS share
FROM (SELECT {S.q(key)} AS {snake_name(key)}, coalesce({S.money_sum('"Estimated Price"')}, 0) AS estimated_price
      FROM ws_clean WHERE {S.q(key)} IS NOT NULL GROUP BY {S.q(key)})"""


@register("workstation_value_by_warehouse", _ws_share_sql("Warehouse"))
def q_workstation_value_by_warehouse(spark, d):
    return snake(workstation_value_by(_ws_clean(spark, d), "Warehouse"))


@register("workstation_value_by_department", _ws_share_sql("Department"))
def q_workstation_value_by_department(spark, d):
    return snake(workstation_value_by(_ws_clean(spark, d), "Department"))


@register("county_phone_value", B.with_ctes("phones", "plans", extra=_PHONES_CLEAN_SQL + ","
                                            + _county_sql("phones_clean", S.money_sum('"Estimated Price"'),
                                                          "v", '"Location"', True)) + """
SELECT n_name AS county, coalesce(c.v, 0) AS estimated_price
FROM nation LEFT JOIN per_county c ON n_name = c.county""")
def q_county_phone_value(spark, d):
    t = county_table(_phones_clean(spark, d), B.county_domain(spark, d), "Estimated Price",
                     B.TEST_COUNTY_OF_LOCATION)
    return snake(t)


# Order of the phone view's rows (the sheet order), then every column as a
# tie-break, so pseudonyms are assigned identically on both sides.
_PHONE_VIEW_ORDER = ["Device ID", "Number", "Administration", "Total Charges"]
_PHONE_VIEW_LOCATION = "NATION_3"


@register("explore_phones", B.with_ctes("phones", "plans", extra=_PHONES_CLEAN_SQL) + f"""
SELECT number, username, equipment_model, device_id, location, administration, storage, monthly_access_charges,
       usage_charges, equipment_charges, surcharges_and_other_charges_and_credits,
       taxes_governmental_surcharges_and_fees, third_party_charges_includes_tax, total_charges,
       estimated_price, annual_phone_bill
FROM (
  SELECT "Number" AS number,
         'User ' || CAST(row_number() OVER (ORDER BY "Device ID" NULLS FIRST, "Number" NULLS FIRST,
                                                      "Administration" NULLS FIRST, total_charges_num NULLS FIRST,
                                                      "Username" NULLS FIRST, "Equipment Model" NULLS FIRST,
                                                      "Location" NULLS FIRST, "Storage" NULLS FIRST) - 1 AS VARCHAR)
           AS username,
         "Equipment Model" AS equipment_model, "Device ID" AS device_id, "Location" AS location,
         CASE "Administration" WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' END AS administration,
         "Storage" AS storage, "Monthly Access Charges" AS monthly_access_charges, "Usage Charges" AS usage_charges,
         "Equipment Charges" AS equipment_charges,
         "Surcharges and Other Charges and Credits" AS surcharges_and_other_charges_and_credits,
         "Taxes Governmental Surcharges and Fees" AS taxes_governmental_surcharges_and_fees,
         "Third Party Charges (Includes Tax)" AS third_party_charges_includes_tax,
         total_charges_num AS total_charges, "Estimated Price" AS estimated_price,
         "Annual Phone Bill" AS annual_phone_bill
  FROM phones_clean)
WHERE location = '{_PHONE_VIEW_LOCATION}'""")
def q_explore_phones(spark, d):
    """The phone view as exported: pseudonyms (W2), Yes/No (C8), one
    location (B6). Columns not in the order list break ties."""
    ph = _phones_clean(spark, d).select(*MERGED_VIEW_COLUMNS)
    ph = anonymise(ph, "Username", [*_PHONE_VIEW_ORDER, "Username", "Equipment Model", "Location", "Storage"])
    ph = ph.withColumn("Administration", map_values(F.col("Administration")))
    return snake(filter_eq(ph, "Location", _PHONE_VIEW_LOCATION))


MERGED_VIEW_COLUMNS = [*MERGED_COLUMNS, "Estimated Price", "Annual Phone Bill"]


@register("inventory_summary_value", B.with_ctes("inventory") + f"""
SELECT combined_section AS combined_section,
       coalesce({S.money_product_sum('"Quantity"', '"Estimated Price"')}, 0) AS total_price
FROM (SELECT *, {S.combine('"Section"', GROUPS)} AS combined_section FROM inventory)
GROUP BY combined_section""")
def q_inventory_summary_value(spark, d):
    """P8 with the price measure over all combined sections."""
    return snake(inventory_summary(B.inventory(spark, d), None, "price", GROUPS))


@register("top_sections", B.with_ctes("inventory") + """
SELECT "Section" AS section, CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS total_quantity
FROM inventory GROUP BY "Section" ORDER BY total_quantity DESC, section ASC NULLS FIRST LIMIT 3""")
def q_top_sections(spark, d):
    """S2 top-k: the three sections with the most items (the limit is the report)."""
    g = group_total(B.inventory(spark, d), "Section", "Quantity", "total_quantity")
    return snake(rank_groups(g, "total_quantity", "Section", top_k=3))


@register("inventory_maintenance", B.with_ctes("inventory", "incoming", "qevents",
                                               extra=_UPSERT_SQL + ",\n" + _APPLY_SQL) + """
SELECT i."Item" AS item,
       CAST(CASE WHEN s.net IS NULL THEN i."Quantity" ELSE i."Quantity" + s.net END AS BIGINT) AS quantity,
       i."Comments" AS comments, i."Section" AS section, i."Estimated Price" AS estimated_price,
       CAST(i."RowID" AS BIGINT) AS rowid
FROM upserted i LEFT JOIN s ON i."RowID" = s.row_id
WHERE NOT coalesce(i."Quantity" + s.fl <= 0, false)""")
def q_inventory_maintenance(spark, d):
    """P10: snapshot v1 = existing items; merge the incoming batch (I1) and
    apply the quantity events (I5); the result is snapshot v2."""
    root = scratch_path(spark, "maintenance")
    existing, incoming = B.split_existing_incoming(spark, d)
    write_snapshot(existing, root, "inventory", version=1)
    version = maintain_inventory(spark, root, "inventory", incoming=incoming, events=B.quantity_events(spark, d))
    return snake(read_snapshot(spark, root, "inventory", version=version))


# ---------------------------------------------------------------------------
# Vendor exports with a preamble (A3) and named view exports
# ---------------------------------------------------------------------------

# Preambles of the test exports: the records above the header, blank lines
# among them, so the header is non-blank record 6 (plans) and 2 (phones).
_PLAN_PREAMBLE = ["Wireless account statement,,", "Account,0000-0000,", "", "Period,monthly,", "Company,example,",
                  "Summary,lines follow,"]
_PHONE_PREAMBLE = ["", "Phone inventory,,", ""]


def write_exports(df: DataFrame, key: str, cols: list[str], preamble: list[str], path: str) -> None:
    """Write a table as vendor-style CSV exports: one file per hash bucket of
    ``key`` (as many buckets as the session has partitions, so files grow in
    number, not size), each with the preamble and header on top. Files of odd
    buckets have their columns in the reverse order."""
    spark = df.sparkSession
    files = default_parallelism(spark)

    def line(names):
        return F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string") for c in names]), {"escape": '"'})

    def header(names):
        return ",".join(f'"{c}"' if "," in c else c for c in names)

    back = cols[::-1]
    heads = [(odd, i, text) for odd, names in enumerate((cols, back))
             for i, text in enumerate([*preamble, header(names)])]
    top = (spark.createDataFrame(heads, "_odd int, _i int, _line string")
           .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
           .where(F.col("_b") % 2 == F.col("_odd")).select("_b", F.lit(0).alias("_kind"), "_i", "_line"))
    bucket = F.pmod(F.xxhash64(key), F.lit(files)).cast("int")
    data = df.select(bucket.alias("_b"), F.lit(1).alias("_kind"), F.lit(0).alias("_i"),
                     F.when(bucket % 2 == 0, line(cols)).otherwise(line(back)).alias("_line"))
    (top.unionByName(data).repartition(files, "_b").sortWithinPartitions("_b", "_kind", "_i")
     .select("_b", "_line").write.partitionBy("_b").text(path))


def write_plan_exports(spark, d, path: str) -> None:
    cols = ["plan_id", "Number / User Name", "Cost Center", *B.PLAN_CHARGE_COLUMNS, "Total Charges"]
    write_exports(B.plans(spark, d), "plan_id", cols, _PLAN_PREAMBLE, path)


@register("read_export", B.with_ctes("plans") + """
SELECT plan_id, "Number / User Name" AS number_user_name, "Cost Center" AS cost_center,
       CASE WHEN "Total Charges" IN ('', 'N/A') THEN NULL ELSE "Total Charges" END AS total_charges
FROM plans""")
def q_read_export(spark, d):
    """A3: plan exports with a preamble read back with the header taken
    from non-blank record 6 (pandas missing-value tokens -> null)."""
    path = scratch_path(spark, "plan-exports")
    write_plan_exports(spark, d, path)
    back = read_export(spark, f"{path}/_b=*/*.txt", header_record=6, types={"plan_id": "bigint"})
    return snake(back.select("plan_id", "Number / User Name", "Cost Center", "Total Charges"))


@register("phone_merge_exports", B.with_ctes("phones", "plans", extra=_PREPARED_PLANS + ",\n" + _MERGED_SQL)
          + _MERGED_OUT.replace('"Total Charges" AS', """CASE WHEN "Total Charges" NOT IN ('', 'N/A')
          THEN "Total Charges" END AS""") + " FROM merged")
def q_phone_merge_exports(spark, d):
    """P1 from the raw exports to the CSV: headers in non-blank records 2 and
    6, columns in either order (A3), rename (B3), merge (J1), write (A6)."""
    root = scratch_path(spark, "phone-exports")
    phones = B.phones(spark, d).withColumnRenamed("Number", "Mobile Number")
    write_exports(phones, "c_custkey", [c for c in phones.columns if c != "c_custkey"], _PHONE_PREAMBLE,
                  f"{root}/phones")
    write_plan_exports(spark, d, f"{root}/plans")
    merged = merge_phones(read_export(spark, f"{root}/phones/_b=*/*.txt", header_record=2),
                          read_export(spark, f"{root}/plans/_b=*/*.txt", header_record=6), admin_keyword=ADMIN)
    write_csv(merged, f"{root}/merged")
    return snake(read_table(spark, f"{root}/merged"))


@register("export_phone_view", ORACLES["explore_phones"])
def q_export_phone_view(spark, d):
    """A8 + A1: the explored phone view written under its derived name and
    read back."""
    root = scratch_path(spark, "views")
    path = export_explored(QUERIES["explore_phones"](spark, d), root, "phone", _PHONE_VIEW_LOCATION)
    if not path.endswith(f"phone_data_{_PHONE_VIEW_LOCATION}.csv"):
        raise RuntimeError(f"unexpected export name {path}")
    types = {"total_charges": "double", "estimated_price": "double", "annual_phone_bill": "double"}
    return read_table(spark, path, types=types, string_cols=["device_id", "number"])


# ---------------------------------------------------------------------------
# GeoJSON county domain (A5)
# ---------------------------------------------------------------------------

def write_feature_collection(spark, d, path: str) -> None:
    """Write the county domain (the nation table: bounded by the dimension,
    not by the data) as one GeoJSON FeatureCollection document."""
    features = B.table(spark, d, "nation").select(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties")).alias("f"))
    doc = features.agg(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))
    doc.coalesce(1).write.json(path)


@register("feature_names", ORACLES["county_phone_counts"])
def q_feature_names(spark, d):
    """A5 + P6: the county list read from a GeoJSON FeatureCollection
    (``features[].properties.name``), completed with phone counts per
    county from the customer table."""
    path = scratch_path(spark, "geojson")
    write_feature_collection(spark, d, path)
    domain = read_feature_names(spark, path, name="County")
    return snake(county_table(B.phones(spark, d), domain, None, B.TEST_COUNTY_OF_LOCATION))


@register("drop_null", f"""
SELECT p_name AS item, CAST(p_size AS BIGINT) AS quantity, p_brand AS comments,
       {_SECNO_SQL} * {_BLOCK} + p_partkey + 1 AS pos
FROM part""")
def q_drop_null(spark, d):
    """The sheet layout without its divider rows (null quantity)."""
    rows_only = drop_null(sheet_with_dividers(spark, d), "Quantity")
    return rows_only.select(F.col("Item").alias("item"), F.col("Quantity").alias("quantity"),
                            F.col("Comments").alias("comments"), "pos")


@register("apply_buttons", ORACLES["apply_quantity_events"])
def q_apply_buttons(spark, d):
    """I3-I5 straight from the clicked button ids (C15 inside the operator)."""
    return snake(apply_buttons(B.inventory(spark, d), B.buttons(spark, d)))


# ---------------------------------------------------------------------------
# Report tables (P9), lookups by expression and by table (J3), exports
# ---------------------------------------------------------------------------

@register("section_totals", B.with_ctes("inventory") + """
SELECT "Section" AS section, CAST(coalesce(sum("Quantity"), 0) AS BIGINT) AS total_quantity
FROM inventory WHERE "Quantity" IS NOT NULL GROUP BY "Section" """)
def q_section_totals(spark, d):
    """P9 ``by_section``: quantity per section, largest first."""
    return snake(section_report(B.inventory(spark, d), groups=GROUPS)["by_section"])


@register("section_drill_down", B.with_ctes("inventory") + """
SELECT "Item" AS item, "Quantity" AS quantity FROM inventory
WHERE "Quantity" IS NOT NULL AND "Section" = 'LARGE'""")
def q_section_drill_down(spark, d):
    """P9 drill-down: one section's items, largest quantity first."""
    return snake(section_report(B.inventory(spark, d), drill_section="LARGE",
                                groups=GROUPS)["drill_down"])


@register("price_distinct_expr", ORACLES["price_distinct"])
def q_price_distinct_expr(spark, d):
    """J3 with a column expression evaluated once per distinct model."""
    ph = enrich_distinct(B.phones(spark, d), "Equipment Model", "Estimated Price", expr=first_number)
    return ph.select("c_custkey", F.col("`Equipment Model`").alias("equipment_model"),
                     F.col("`Estimated Price`").alias("estimated_price"))


@register("price_distinct_table", B.with_ctes("inventory") + """
SELECT i."RowID" AS rowid, i."Section" AS section, coalesce(p.price, -1) AS section_price
FROM inventory i LEFT JOIN (SELECT p_type AS k, max(p_retailprice) AS price FROM part WHERE p_size < 50 GROUP BY 1) p
  ON i."Section" IS NOT DISTINCT FROM p.k""")
def q_price_distinct_table(spark, d):
    """J3 with an existing key -> value table: the highest price of a section."""
    prices = (B.table(spark, d, "part").where("p_size < 50").groupBy(F.col("p_type").alias("Section"))
              .agg(F.max("p_retailprice").alias("price")))
    inv = enrich_distinct(B.inventory(spark, d), "Section", "section_price", table=prices, table_value="price",
                          default=-1.0)
    return inv.select(F.col("RowID").alias("rowid"), F.col("Section").alias("section"), "section_price")


def _workstation_rows(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", F.col("Device").alias("device"),
                     F.col("Warehouse").alias("warehouse"), F.col("Department").alias("department"),
                     F.col("Estimated Price").alias("estimated_price"))


@register("export_workstation_view", B.with_ctes("workstations", extra=_WS_CLEAN_SQL) + """
SELECT l_orderkey, l_linenumber, "Device" AS device, "Warehouse" AS warehouse, "Department" AS department,
       "Estimated Price" AS estimated_price
FROM ws_clean WHERE "Department" = 'Dept F'""")
def q_export_workstation_view(spark, d):
    """A8 for workstations: one department (B9) written under its derived
    name, whose label holds a blank (C14), and read back."""
    view = _workstation_rows(explore_workstations(_ws_clean(spark, d), "Department", "Dept F"))
    path = export_explored(view, scratch_path(spark, "views"), "workstation", "Dept F", category="Department")
    if not path.endswith("/department_dept_f_data.csv"):
        raise RuntimeError(f"unexpected export name {path}")
    return read_table(spark, path, types={"l_orderkey": "bigint", "l_linenumber": "int",
                                          "estimated_price": "double"})


@register("export_server_view", B.with_ctes("inventory") + """
SELECT "Item" AS item, "Quantity" AS quantity, nullif("Comments", '') AS comments, "Section" AS section,
       "Estimated Price" AS estimated_price, "RowID" AS rowid FROM inventory WHERE "Section" = 'LARGE'""")
def q_export_server_view(spark, d):
    """A8 for servers: one label, whose case is kept (C14)."""
    path = export_explored(snake(explore(B.inventory(spark, d), "Section", "LARGE")), scratch_path(spark, "views"),
                           "server", "LARGE")
    if not path.endswith("/server_data_LARGE.csv"):
        raise RuntimeError(f"unexpected export name {path}")
    return _read_inventory(spark, path)


def _read_inventory(spark, path: str) -> DataFrame:
    """An exported inventory; the pandas style reads '' back as missing."""
    return read_table(spark, path, types={"quantity": "bigint", "estimated_price": "double", "rowid": "bigint"})


@register("export_inventory_view", B.with_ctes("inventory") + """
SELECT "Item" AS item, "Quantity" AS quantity, nullif("Comments", '') AS comments, "Section" AS section,
       "Estimated Price" AS estimated_price, "RowID" AS rowid FROM inventory""")
def q_export_inventory_view(spark, d):
    """A8 for the whole inventory under its dated name (C17)."""
    path = export_view(snake(B.inventory(spark, d)), scratch_path(spark, "views"), "inventory",
                       today=dt.date(2024, 5, 1))
    if not path.endswith("/inventory-2024-05-01.csv"):
        raise RuntimeError(f"unexpected export name {path}")
    return _read_inventory(spark, path)


@register("source_position", B.with_ctes("inventory") + f"""
SELECT {_inv_cols_sql()}, row_number() OVER (ORDER BY "RowID") AS position FROM
(SELECT * REPLACE (nullif("Comments", '') AS "Comments") FROM inventory)""")
def q_source_position(spark, d):
    """W1 by the place in the source: the inventory written as CSV files in
    the order of its ids, read back with each row's position."""
    path = scratch_path(spark, "positions-source")
    write_csv(snake(B.inventory(spark, d)).orderBy("rowid"), path)
    return read_table(spark, path, types={"quantity": "bigint", "estimated_price": "double", "rowid": "bigint"},
                      position="position")


# ---------------------------------------------------------------------------
# Pages and searches over written indexes (S4), the dashboard as one run
# ---------------------------------------------------------------------------

# Page of ten rows that the deep query shows; every given size has it.
_DEEP_PAGE = 100


@register("table_page_deep", f"""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET {_DEEP_PAGE * 10}""")
def q_table_page_deep(spark, d):
    """S4 far down: the orders laid out in ranges once, one page read back."""
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return write_paged(o, scratch_path(spark, "paged"), [("o_totalprice", False), ("o_orderkey", True)]).page(_DEEP_PAGE, 10)


@register("table_search_indexed", B.with_ctes("inventory") + f"""
SELECT {INV_COLS} FROM inventory
WHERE {' OR '.join(f"coalesce(contains(lower(CAST({S.q(c)} AS VARCHAR)), '{_SEARCH}'), false)"
                   for c in ["Item", "Quantity", "Comments", "Section", "Estimated Price", "RowID"])}""")
def q_table_search_indexed(spark, d):
    """S4 search through an n-gram index of all columns, checked exactly."""
    inv, index = B.inventory(spark, d), scratch_path(spark, "grams")
    write_gram_index(inv, index, "RowID")
    return snake(search_indexed(inv, index, "RowID", _SEARCH))


@register("dashboard_run", B.with_ctes("phones", "plans", extra=_PHONES_CLEAN_SQL + ","
                                       + _county_sql("phones_clean", "count(*)", "n", '"Location"', False)) + f"""
SELECT 'cards' AS panel, 'Total Phone Value' AS key, {S.money_sum('"Estimated Price"')} AS value FROM phones_clean
UNION ALL SELECT 'cards', 'Total Annual Phone Bills', {S.money_sum('"Annual Phone Bill"')} FROM phones_clean
UNION ALL SELECT 'phone_bill_by_administration', CASE "Administration" WHEN 'Y' THEN 'Yes' ELSE 'No' END,
  coalesce({S.money_sum('"Annual Phone Bill"')}, 0) FROM phones_clean WHERE "Administration" IN ('Y', 'N') GROUP BY 1, 2
UNION ALL SELECT 'county_phone_count', n_name, CAST(coalesce(c.n, 0) AS DOUBLE) FROM nation LEFT JOIN per_county c ON n_name = c.county
UNION ALL SELECT 'county_workstation_value', n_name, 0.0 FROM nation""")
def q_dashboard_run(spark, d):
    """P4-P6 as one run over snapshots: an inventory without a price column (no
    storage card, B10), an absent workstation table (A4, B11: no card, zero per
    county) and the phones."""
    root = scratch_path(spark, "dashboard")
    storage, phones = B.inventory(spark, d).drop("Estimated Price"), _merged_prices(spark, d)
    write_snapshot(storage, root, "storage")
    write_snapshot(phones, root, "phones")
    tables = load_dashboard(spark, root, {"storage": "storage", "phones": "phones", "workstations": "workstations"},
                            {"storage": storage.schema, "phones": phones.schema, "workstations": B.workstations(spark, d).schema})
    panels = dashboard_tables(tables, B.county_domain(spark, d), B.TEST_COUNTY_OF_LOCATION)
    if "storage_by_category" in panels:
        raise RuntimeError("a storage panel without prices")
    shown = {"cards": ("metric", "value"), "phone_bill_by_administration": ("Administration", "Annual Phone Bill"),
             "county_phone_count": ("County", "Number of Phones"), "county_workstation_value": ("County", "Estimated Price")}
    parts = [panels[p].select(F.lit(p).alias("panel"), F.col(f"`{k}`").alias("key"), F.col(f"`{v}`").cast("double").alias("value"))
             for p, (k, v) in shown.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register("literal_rows", """
SELECT section, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN split_part(p_type, ' ', 1) IN ('SMALL', 'LARGE') THEN split_part(p_type, ' ', 1) END AS p FROM part)
JOIN (VALUES ('SMALL', 'Small & Medium'), ('LARGE', 'Large'), (NULL, 'None')) t(k, section) ON k IS NOT DISTINCT FROM p
GROUP BY section""")
def q_literal_rows(spark, d):
    """A literal table, null key included, met with every part."""
    names = from_rows(spark, [("SMALL", "Small & Medium"), ("LARGE", "Large"), (None, "None")], "k string, section string")
    word = F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))
    parts = B.table(spark, d, "part").select(F.when(word.isin("SMALL", "LARGE"), word).alias("p"))
    return parts.join(names, parts.p.eqNullSafe(names.k)).groupBy("section").agg(F.count("*").alias("n"))


@register("upsert_bucketed", ORACLES["upsert_items"])
def q_upsert_bucketed(spark, d):
    """I1 into a table in buckets of the match key: the touched ones are written."""
    existing, incoming = B.split_existing_incoming(spark, d)
    table = BucketedItems(spark, scratch_path(spark, "bucketed"), existing.schema, default_parallelism(spark))
    table.write(existing)
    table.upsert(incoming)
    return snake(table.read())
