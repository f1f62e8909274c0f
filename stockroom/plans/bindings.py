"""Role tables derived from the given test tables.

Each role (inventory, phones, plans, workstations, quantity events) is built
from whole tables by column expressions and joins, so its size grows with the
input. Every builder has a DuckDB twin in ``SQL_CTES`` that derives the same
rows for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import format_money
from ..functions.text import parse_event
from ..sources.readers import read_parquet


# The given tables are read-only: one DataFrame per (application, table)
# saves re-listing files and re-reading footers in every query.
_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df


# Section roll-up used with the test inventory (its sections are part types);
# STANDARD is left unmapped and keeps its own name.
TEST_SECTION_GROUPS = [
    ("Small & Medium", ["SMALL", "MEDIUM"]),
    ("Large", ["LARGE"]),
    ("Promo & Economy", ["PROMO", "ECONOMY"]),
]
TEST_SELECTED_SECTIONS = ["Small & Medium", "Large", "STANDARD"]

# Location -> county mapping used with the test phones (two locations share
# one county, as a city and its county do).
TEST_COUNTY_OF_LOCATION = {"NATION_0": "NATION_1"}


def _per_application(build):
    """Build a role table once per (application, folder): the given tables
    are read-only, so the plan can be shared by every query."""
    memo: dict[tuple, DataFrame] = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in memo:
            memo[key] = build(spark, sf_dir)
        return memo[key]
    get.__name__, get.__doc__ = build.__name__, build.__doc__
    return get


def _s(c) -> Column:
    return F.col(c).cast("string")


def _digits10(key: str) -> Column:
    return F.lpad(_s(key), 10, "0")


def _dotted_number(key: str, sep: str) -> Column:
    d = _digits10(key)
    return F.concat_ws(sep, F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))


@_per_application
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item, Quantity, Comments, Section, Estimated Price, RowID from ``part``.

    Some items are upper-cased and padded (equal under the C10 key), some
    comments are null or '' (also equal), some sections are null.
    """
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.when(size > 40, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("Item"),
        size.cast("bigint").alias("Quantity"),
        F.when(size <= 10, F.lit(None).cast("string")).when(size <= 20, F.lit("")).otherwise(F.col("p_brand"))
        .alias("Comments"),
        F.when(size == 50, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("Section"),
        F.col("p_retailprice").alias("Estimated Price"),
        (F.col("p_partkey") + 1).alias("RowID"))


@_per_application
def incoming_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of items to add, from ``part``: blank names, negative and null
    prices, extra inner blanks, and arrival order ``seq``."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    item = (F.when(size == 1, F.lit("   "))
            .when(size.between(30, 35), F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   "))))
            .otherwise(F.col("p_name")))
    price = (F.when(size == 2, -F.col("p_retailprice")).when(size == 3, F.lit(None).cast("double"))
             .otherwise(F.col("p_retailprice")))
    return p.select(
        item.alias("Item"),
        (size % 7 + 1).cast("bigint").alias("Quantity"),
        F.when(size <= 15, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("Comments"),
        F.col("p_type").alias("Section"),
        price.alias("Estimated Price"),
        F.col("p_partkey").alias("seq"))


def split_existing_incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even part keys form the existing table, odd ones the incoming batch:
    the two halves together use every part row (a role split, not a sample)."""
    existing = inventory(spark, sf_dir).where((F.col("RowID") - 1) % 2 == 0)
    incoming = incoming_items(spark, sf_dir).where(F.col("seq") % 2 == 1)
    return existing, incoming


@_per_application
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone inventory (already renamed: Number) from ``customer``."""
    c = table(spark, sf_dir, "customer")
    nk = _s("c_nationkey")
    seg = F.col("c_mktsegment")
    model = (F.when(seg == "AUTOMOBILE", F.concat(F.lit("iPhone "), nk))
             .when(seg == "BUILDING", F.concat(F.lit("Galaxy GS"), nk, F.lit(" FE")))
             .when(seg == "FURNITURE", F.concat(F.lit("Galaxy S"), nk, F.lit(" Plus")))
             .when(seg == "HOUSEHOLD", F.concat(F.lit("iPhone "), nk, F.lit(" Mini")))
             .otherwise(F.concat(F.lit("XCover Pro "), nk)))
    return c.select(
        F.col("c_custkey"),
        F.when(F.col("c_acctbal") < -900, F.lit(None).cast("string")).otherwise(_dotted_number("c_custkey", "."))
        .alias("Number"),
        F.col("c_name").alias("Username"),
        model.alias("Equipment Model"),
        F.concat(F.lit("35"), F.lpad(_s("c_custkey"), 13, "0")).alias("Device ID"),
        F.when(F.col("c_acctbal") > 9000, F.lit("Remote")).otherwise(F.concat(F.lit("NATION_"), nk)).alias("Location"),
        seg.alias("Storage"))


# The charge columns of a plan export, in order.
PLAN_CHARGE_COLUMNS = ["Monthly Access Charges", "Usage Charges", "Equipment Charges",
                       "Surcharges and Other Charges and Credits", "Taxes Governmental Surcharges and Fees",
                       "Third Party Charges (Includes Tax)"]


@_per_application
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw phone plan lines: one per order (number and user in one text,
    cost centre, charges as money text with 'N/A' and '' mixed in), plus one
    account-summary line without a number per nation, as a vendor export
    carries. Null numbers on this side stay bounded by the nation table, so
    the null-safe merge does not grow with the square of the data."""
    o = table(spark, sf_dir, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    num = _dotted_number("o_custkey", "-")
    text = (F.when((st == "P") & (pr == "1-URGENT"), num)
            .otherwise(F.concat(num, F.lit("  User "), _s("o_custkey"))))
    total = (F.when((st == "F") & (pr == "4-NOT SPECIFIED"), F.lit("N/A"))
             .when((st == "O") & (pr == "5-LOW"), F.lit(""))
             .otherwise(format_money(F.col("o_totalprice"))))
    charges = [F.lit("$40.00" if c == "Monthly Access Charges" else "$0.00").alias(c) for c in PLAN_CHARGE_COLUMNS]
    lines = o.select(F.col("o_orderkey").alias("plan_id"), text.alias("Number / User Name"),
                     pr.alias("Cost Center"), *charges, total.alias("Total Charges"))
    n = table(spark, sf_dir, "nation")
    summary = n.select((-(F.col("n_nationkey").cast("bigint") + 1)).alias("plan_id"),
                       F.concat(F.lit("Account summary "), F.col("n_name")).alias("Number / User Name"),
                       F.lit("SUMMARY").alias("Cost Center"), *charges, F.lit("N/A").alias("Total Charges"))
    return lines.unionByName(summary)


@_per_application
def workstations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workstation devices from ``lineitem``; the warehouse is the
    supplier's nation. Estimated Price is money text."""
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    j = (li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey))
    return j.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("Device "), F.col("l_returnflag")).alias("Device"),
        F.col("n_name").alias("Warehouse"),
        F.concat(F.lit("Dept "), F.col("l_linestatus")).alias("Department"),
        format_money(F.col("l_extendedprice")).alias("Estimated Price"))


@_per_application
def county_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("County"))


@_per_application
def buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Button ids clicked, from ``events``: click = plus, error = minus."""
    e = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "click", F.lit("plus_"))
            .when(F.col("event_type") == "error", F.lit("minus_")).otherwise(F.lit("other_")))
    return e.select("event_id", "ts", F.concat(kind, _s("user_id")).alias("button"))


@_per_application
def quantity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed quantity events (row_id, delta, ts, event_id); others dropped."""
    return parse_buttons(buttons(spark, sf_dir))


def parse_buttons(b: DataFrame) -> DataFrame:
    row_id, delta = parse_event(F.col("button"))
    return (b.select("event_id", "ts", row_id.alias("row_id"), delta.alias("delta"))
            .where(F.col("delta").isNotNull()))


# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------

def _sql_dotted(key: str, sep: str) -> str:
    d = f"lpad(CAST({key} AS VARCHAR), 10, '0')"
    return f"substr({d}, 1, 3) || '{sep}' || substr({d}, 4, 3) || '{sep}' || substr({d}, 7, 4)"


SQL_MONEY = "'$' || format('{{:,.2f}}', {x})"

SQL_CTES = {
    "inventory": """
inventory AS (
  SELECT CASE WHEN p_size > 40 THEN ' ' || upper(p_name) || ' ' ELSE p_name END AS "Item",
         CAST(p_size AS BIGINT) AS "Quantity",
         CASE WHEN p_size <= 10 THEN NULL WHEN p_size <= 20 THEN '' ELSE p_brand END AS "Comments",
         CASE WHEN p_size = 50 THEN NULL ELSE p_type END AS "Section",
         p_retailprice AS "Estimated Price",
         p_partkey + 1 AS "RowID"
  FROM part)""",
    "incoming": """
incoming AS (
  SELECT CASE WHEN p_size = 1 THEN '   '
              WHEN p_size BETWEEN 30 AND 35 THEN '  ' || replace(p_name, ' ', '   ')
              ELSE p_name END AS "Item",
         CAST(p_size % 7 + 1 AS BIGINT) AS "Quantity",
         CASE WHEN p_size <= 15 THEN NULL ELSE p_brand END AS "Comments",
         p_type AS "Section",
         CASE WHEN p_size = 2 THEN -p_retailprice WHEN p_size = 3 THEN NULL ELSE p_retailprice END
           AS "Estimated Price",
         p_partkey AS seq
  FROM part)""",
    "phones": f"""
phones AS (
  SELECT c_custkey,
         CASE WHEN c_acctbal < -900 THEN NULL ELSE {_sql_dotted('c_custkey', '.')} END AS "Number",
         c_name AS "Username",
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'iPhone ' || CAST(c_nationkey AS VARCHAR)
              WHEN 'BUILDING' THEN 'Galaxy GS' || CAST(c_nationkey AS VARCHAR) || ' FE'
              WHEN 'FURNITURE' THEN 'Galaxy S' || CAST(c_nationkey AS VARCHAR) || ' Plus'
              WHEN 'HOUSEHOLD' THEN 'iPhone ' || CAST(c_nationkey AS VARCHAR) || ' Mini'
              ELSE 'XCover Pro ' || CAST(c_nationkey AS VARCHAR) END AS "Equipment Model",
         '35' || lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS "Device ID",
         CASE WHEN c_acctbal > 9000 THEN 'Remote' ELSE 'NATION_' || CAST(c_nationkey AS VARCHAR) END AS "Location",
         c_mktsegment AS "Storage"
  FROM customer)""",
    "plans": f"""
plans AS (
  SELECT o_orderkey AS plan_id,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN {_sql_dotted('o_custkey', '-')}
              ELSE {_sql_dotted('o_custkey', '-')} || '  User ' || CAST(o_custkey AS VARCHAR) END
           AS "Number / User Name",
         o_orderpriority AS "Cost Center",
         '$40.00' AS "Monthly Access Charges", '$0.00' AS "Usage Charges", '$0.00' AS "Equipment Charges",
         '$0.00' AS "Surcharges and Other Charges and Credits",
         '$0.00' AS "Taxes Governmental Surcharges and Fees",
         '$0.00' AS "Third Party Charges (Includes Tax)",
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'N/A'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN ''
              ELSE {SQL_MONEY.format(x='o_totalprice')} END AS "Total Charges"
  FROM orders
  UNION ALL
  SELECT -(CAST(n_nationkey AS BIGINT) + 1), 'Account summary ' || n_name, 'SUMMARY',
         '$40.00', '$0.00', '$0.00', '$0.00', '$0.00', '$0.00', 'N/A'
  FROM nation)""",
    "workstations": f"""
workstations AS (
  SELECT l_orderkey, l_linenumber, 'Device ' || l_returnflag AS "Device", n_name AS "Warehouse",
         'Dept ' || l_linestatus AS "Department", {SQL_MONEY.format(x='l_extendedprice')} AS "Estimated Price"
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "qevents": """
qevents AS (
  SELECT event_id, ts,
         CAST(regexp_extract(button, '^(plus|minus)_(\\d+)$', 2) AS BIGINT) AS row_id,
         CASE regexp_extract(button, '^(plus|minus)_(\\d+)$', 1) WHEN 'plus' THEN 1 WHEN 'minus' THEN -1 END AS delta
  FROM (SELECT event_id, ts,
               CASE event_type WHEN 'click' THEN 'plus_' WHEN 'error' THEN 'minus_' ELSE 'other_' END
                 || CAST(user_id AS VARCHAR) AS button
        FROM events)
  WHERE regexp_extract(button, '^(plus|minus)_(\\d+)$', 1) <> '')""",
}

def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named role CTEs plus ``extra`` CTE text."""
    parts = [SQL_CTES[n].strip() for n in names]
    if extra.strip():
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
