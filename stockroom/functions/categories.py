"""Category and lookup column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col, when_chain

# The inventory section roll-up. Combined section first, then the
# sections it covers; a section not listed keeps its own name.
DEFAULT_SECTION_GROUPS: list[tuple[str, list[str]]] = [
    ("Laptops & Accessories", ["Laptops", "Laptop Chargers", "Laptop Batteries", "Laptop Accessories"]),
    ("Tablets & Accessories", ["Tablets", "Tablet Chargers", "Tablet Cases and Accessories"]),
    ("Phones & Accessories", ["Phones", "Phone Cases"]),
    ("Networking Equipment", ["Networking Equipment", "Access Points"]),
    ("Storage Devices", ["Storage Devices"]),
    ("Printers & Scanners", ["Printers and Scanners"]),
    ("Audio & Video Equipment", ["Audio and Video Equipment"]),
    ("Cables & Adapters", ["Cables and Adapters"]),
    ("Peripherals & Displays", ["Computer Peripherals", "Monitors", "TVs"]),
    ("Miscellaneous & Accessories", ["Miscellaneous Tech", "Other Accessories"]),
]

# Office location -> county where the two differ.
DEFAULT_COUNTY_OF_LOCATION: dict[str, str] = {"Columbia": "Richland"}

# Administration flag display labels.
YES_NO_LABELS: dict[str, str] = {"Y": "Yes", "N": "No"}


def combine_sections(col, groups: Sequence[tuple[str, Sequence[str]]] = DEFAULT_SECTION_GROUPS) -> Column:
    """Map a section to its combined section; unlisted -> itself, null -> null."""
    c = as_col(col)
    return when_chain(((c.isin(list(members)), F.lit(name)) for name, members in groups),
                      otherwise=c, use_otherwise=True)


def map_or_self(col, mapping: Mapping[str, str] = DEFAULT_COUNTY_OF_LOCATION) -> Column:
    """Replace mapped values, keep everything else."""
    c = as_col(col)
    return when_chain(((c == k, F.lit(v)) for k, v in mapping.items()), otherwise=c, use_otherwise=True)


def map_values(col, mapping: Mapping[str, str] = YES_NO_LABELS) -> Column:
    """Replace mapped values; anything unmapped becomes null."""
    c = as_col(col)
    return when_chain((c == k, F.lit(v)) for k, v in mapping.items())


def fill_default(col, value) -> Column:
    return F.coalesce(as_col(col), F.lit(value))
