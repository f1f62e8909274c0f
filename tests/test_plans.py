"""Composed jobs on literal rows."""

from pyspark.sql import functions as F

from stockroom.plans.dashboard import clean_table, county_table, summary_cards
from stockroom.plans.inventory import PRICE_NOT_AVAILABLE, inventory_summary, maintain_inventory, section_report
from stockroom.plans.phones import MERGED_COLUMNS, merge_phones, price_phones, price_phones_distinct
from stockroom.sources import read_snapshot, write_snapshot

from conftest import rows

PLAN_COLS = ["Number / User Name", "Cost Center", "Monthly Access Charges", "Usage Charges", "Equipment Charges",
             "Surcharges and Other Charges and Credits", "Taxes Governmental Surcharges and Fees",
             "Third Party Charges (Includes Tax)", "Total Charges"]


def _phones(spark):
    inv = spark.createDataFrame([
        ("803.555.0100", "Ann", "Galaxy GS20 FE", "350000000000001", "Columbia", "64GB"),
        ("803.555.0199", "Bob", "iPhone 13", "350000000000002", "Charleston", "128GB"),
    ], "`Mobile Number` string, Username string, `Equipment Model` string, `Device ID` string, "
       "Location string, Storage string")
    plans = spark.createDataFrame([
        ("803-555-0100  Ann", "HH ADMIN", "$40.00", "$0.00", "$0.00", "$0.00", "$0.00", "$0.00", "$1,234.50"),
        ("Totals", "", "", "", "", "", "", "", "$1,234.50"),
    ], ", ".join(f"`{c}` string" for c in PLAN_COLS))
    return inv, plans


def test_merge_phones_unmatched_phone_has_null_flag(spark):
    inv, plans = _phones(spark)
    merged = merge_phones(inv, plans)
    assert merged.columns == MERGED_COLUMNS
    got = {r["Username"]: (r["Administration"], r["Total Charges"]) for r in merged.collect()}
    assert got == {"Ann": ("Y", "$1,234.50"), "Bob": (None, None)}


def test_pricing_and_cleaning(spark):
    inv, plans = _phones(spark)
    priced = price_phones(merge_phones(inv, plans))
    assert rows(priced, "Username", "Estimated Price") == [("Ann", 300.0), ("Bob", 700.0)]
    distinct = price_phones_distinct(inv)
    assert rows(distinct, "Username", "Estimated Price") == [("Ann", 20.0), ("Bob", 13.0)]
    clean = clean_table(priced.withColumn("RowID", F.lit(1)))
    assert "RowID" not in clean.columns
    assert rows(clean, "Username", "Total Charges", "Annual Phone Bill") == [("Ann", 1234.5, 14814.0),
                                                                            ("Bob", None, None)]
    cards = {r["metric"]: r["display"] for r in summary_cards(None, clean, None).collect()}
    assert cards == {"Total Phone Value": "$1,000.00", "Total Annual Phone Bills": "$14,814.00"}


def test_county_table_worked_example(spark):
    phones = spark.createDataFrame([("Charleston",)] + [("Columbia",)] * 3 + [("Greenville",)] * 3, "Location string")
    domain = spark.createDataFrame([(c,) for c in ["Aiken", "Charleston", "Greenville", "Richland"]], "County string")
    out = county_table(phones, domain)
    assert rows(out) == [("Aiken", 0), ("Charleston", 1), ("Greenville", 3), ("Richland", 3)]


def test_inventory_summary_and_report(spark):
    inv = spark.createDataFrame([("a", 12, "Laptops"), ("b", 3, "Laptop Chargers"), ("c", None, "TVs"),
                                 ("d", 11, "Monitors")], "Item string, Quantity long, Section string")
    out = inventory_summary(inv, ["Laptops & Accessories"])
    assert [tuple(r) for r in out.collect()] == [("Laptops & Accessories", 15)]
    try:
        inventory_summary(inv, None, measure="price")
        raise AssertionError("expected the price measure to be unavailable")
    except ValueError as e:
        assert str(e) == PRICE_NOT_AVAILABLE
    report = section_report(inv, threshold=10, drill_section="Laptops")
    assert rows(report["top_sections"]) == [("Laptops", 12), ("Monitors", 11)]
    assert rows(report["drill_down"]) == [("a", 12)]
    assert rows(report["combined"], "Combined_Section", "Total_Quantity") == [
        ("Laptops & Accessories", 15), ("Peripherals & Displays", 11)]


def test_maintain_inventory_versions(spark, tmp_dir):
    inv = spark.createDataFrame([("dock", 2, None, "Laptops", 1)],
                                "Item string, Quantity long, Comments string, Section string, RowID long")
    write_snapshot(inv, tmp_dir, "inventory", version=1)
    incoming = spark.createDataFrame([(" Dock", 1, "", "Tablets", 1), ("pen", 4, None, "Other", 2)],
                                     "Item string, Quantity long, Comments string, Section string, seq long")
    events = spark.createDataFrame([(1, 1, 2, -1)], "event_id long, ts long, row_id long, delta int")
    v = maintain_inventory(spark, tmp_dir, "inventory", incoming=incoming, events=events)
    assert v == 2
    assert rows(read_snapshot(spark, tmp_dir, "inventory")) == [("dock", 3, None, "Laptops", 1),
                                                              ("pen", 3, None, "Other", 2)]


def test_dashboard_from_snapshots(spark, tmp_dir):
    from stockroom.plans.dashboard import dashboard_tables, load_dashboard
    storage = spark.createDataFrame([("a", 2, "Laptops", "Laptops & Accessories", "$10.50", 1)],
                                    "Item string, Quantity long, Section string, Combined_Section string, "
                                    "`Estimated Price` string, RowID long")
    storage.write.parquet(f"{tmp_dir}/TechInventory")
    phones = spark.createDataFrame([("Columbia", "Y", "$100.00", 300.0), ("Charleston", "N", "$1,000.00", 0.0)],
                                   "Location string, Administration string, `Total Charges` string, "
                                   "`Estimated Price` double")
    phones.write.parquet(f"{tmp_dir}/FullPhones")
    schemas = {"storage": storage.schema, "phones": phones.schema,
               "workstations": spark.createDataFrame([], "Device string, Warehouse string, Department string, "
                                                         "`Estimated Price` string").schema}
    names = {"storage": "TechInventory", "phones": "FullPhones", "workstations": "StationaryTech"}
    tables = load_dashboard(spark, tmp_dir, names, schemas)
    assert tables["workstations"].count() == 0      # missing table: empty, panels skip it
    domain = spark.createDataFrame([("Richland",), ("Charleston",), ("Aiken",)], "County string")
    out = dashboard_tables(tables, domain)
    cards = {r["metric"]: r["value"] for r in out["cards"].collect()}
    assert cards == {"Total Storage Value": 21.0, "Total Phone Value": 300.0, "Total Annual Phone Bills": 13200.0}
    assert rows(out["county_annual_bill"]) == [("Aiken", 0.0), ("Charleston", 12000.0), ("Richland", 1200.0)]
    assert rows(out["phone_bill_by_administration"]) == [("No", 12000.0, 0.909091), ("Yes", 1200.0, 0.090909)]
    assert rows(out["workstation_value_by_device"]) == []


def test_maintenance_keeps_rejected_rows(spark, tmp_dir):
    inv = spark.createDataFrame([("dock", 2, None, "Laptops", 1)],
                                "Item string, Quantity long, Comments string, Section string, RowID long")
    write_snapshot(inv, tmp_dir, "inventory", version=1)
    incoming = spark.createDataFrame([("", 1, "", "Tablets", 1), ("pen", 4, None, "Other", 2)],
                                     "Item string, Quantity long, Comments string, Section string, seq long")
    maintain_inventory(spark, tmp_dir, "inventory", incoming=incoming)
    rejected = read_snapshot(spark, tmp_dir, "inventory_rejected")
    assert rejected.count() == 1 and len(rejected.columns) > len(incoming.columns)
