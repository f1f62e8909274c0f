"""Golden totals of FIXTURES.md section 2 on literal rows with those sections.

Each section's quantity is laid out as single items plus one row with the
rest, read back from CSV, so the totals pass through the same reader, row
ids and roll-up as a shipped file would.
"""

import os

import pytest

from stockroom.operators import collapse_items, group_total, having_gt
from stockroom.plans.inventory import with_combined_section
from stockroom.sources import read_table

# Expected values, as listed in FIXTURES.md section 2.
BY_SECTION = {
    "Cables and Adapters": 101, "Miscellaneous Tech": 26, "Tablet Cases and Accessories": 20,
    "Other Accessories": 20, "Laptops": 19, "Networking Equipment": 17, "Tablets": 15, "Storage Devices": 9,
    "Phones": 7, "Monitors": 6, "Printers and Scanners": 6, "Audio and Video Equipment": 6, "Phone Cases": 6,
    "Laptop Accessories": 5, "TVs": 5, "Computer Peripherals": 5, "Laptop Chargers": 4, "Tablet Chargers": 3,
    "Laptop Batteries": 2,
}
BY_COMBINED = {
    "Cables & Adapters": 101, "Miscellaneous & Accessories": 46, "Tablets & Accessories": 38,
    "Laptops & Accessories": 30, "Networking Equipment": 17, "Peripherals & Displays": 16,
    "Phones & Accessories": 13, "Storage Devices": 9, "Audio & Video Equipment": 6, "Printers & Scanners": 6,
}


@pytest.fixture(scope="module")
def inventory(spark, tmp_path_factory):
    lines = ["Item,Quantity,Comments,Section"]
    for section, total in BY_SECTION.items():
        lines += [f'{section} item,1,,"{section}"', f'"{section.upper()} item ",{total - 1},,"{section}"']
    path = os.path.join(tmp_path_factory.mktemp("golden"), "inventory.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return read_table(spark, path, types={"Quantity": "bigint"}, style="readr", position="RowID")


def test_rows_and_total(inventory):
    assert [r["RowID"] for r in inventory.orderBy("RowID").collect()] == list(range(1, 2 * len(BY_SECTION) + 1))
    assert sum(BY_SECTION.values()) == 282 == inventory.groupBy().sum("Quantity").first()[0]


def test_totals_by_section_and_threshold(inventory):
    by_section = group_total(inventory, "Section", "Quantity", "total")
    assert {r["Section"]: r["total"] for r in by_section.collect()} == BY_SECTION
    assert having_gt(by_section, "total", 10).count() == 7


def test_totals_by_combined_section(inventory):
    combined = group_total(with_combined_section(inventory), "Combined_Section", "Quantity", "total")
    assert {r["Combined_Section"]: r["total"] for r in combined.collect()} == BY_COMBINED


def test_duplicates_collapse(inventory):
    merged = collapse_items(inventory)
    assert {r["Section"]: (r["Item"], r["Quantity"]) for r in merged.collect()} == {
        s: (f"{s} item", q) for s, q in BY_SECTION.items()}
