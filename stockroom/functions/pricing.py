"""Price estimation column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col, when_chain
from .text import trim_ws

# Ordered keyword -> estimated price rules for equipment models.
# The first keyword found as a whole word (after upper-casing) sets the price;
# order carries meaning ('S20 FE' before 'S20', '13 MINI' before '13').
DEFAULT_PRICE_RULES: list[tuple[str, int]] = [
    ("S20 FE", 300),
    ("S21 FE", 400),
    ("S20 PLUS", 450),
    ("S20", 350),
    ("13 MINI", 650),
    ("14", 800),
    ("13", 700),
    ("12", 600),
    ("XR", 400),
    ("6S", 200),
    ("A54", 250),
    ("JETPACK MIFI 8800L", 100),
    ("XCOVER PRO", 350),
]

# The price when no rule matches, and the value the
# distinct-model price function gives a model without a number.
NO_MATCH_PRICE = 0
FIRST_NUMBER_DEFAULT = 100.0


def keyword_pattern(keyword: str) -> str:
    """Java regex matching ``keyword`` literally as a whole word.

    ``(?U)`` makes ``\\b`` Unicode-aware, as Python's ``re`` is for str.
    """
    if "\\E" in keyword:
        raise ValueError(f"keyword may not contain \\E: {keyword!r}")
    return f"(?U)\\b\\Q{keyword}\\E\\b"


def clean_model(col) -> Column:
    """Replace 'GS' by 'S' (case-sensitive, everywhere), then trim."""
    return trim_ws(F.replace(as_col(col), F.lit("GS"), F.lit("S")))


def price_by_rules(col, rules: Sequence[tuple[str, float]] = DEFAULT_PRICE_RULES,
                   default=NO_MATCH_PRICE) -> Column:
    """Ordered whole-word keyword rules on upper(col); first match wins.

    One CASE WHEN evaluated in generated code. For thousands of rules use
    ``operators.lookup.price_by_rule_table``, which turns the rules into an
    equi-join instead of one regex test per rule and row.
    """
    up = F.upper(as_col(col))
    # A whole-word match implies plain containment; the cheap test runs first
    # and the regex only on texts that contain the keyword.
    return when_chain(((up.contains(k.upper()) & up.rlike(keyword_pattern(k.upper())), F.lit(p)) for k, p in rules),
                      otherwise=F.lit(default), use_otherwise=True)


def estimate_price(col, rules: Sequence[tuple[str, float]] = DEFAULT_PRICE_RULES) -> Column:
    """C3 then C2: the rule price of a raw equipment model text."""
    return price_by_rules(clean_model(col), rules)


def first_number(col, default: float = FIRST_NUMBER_DEFAULT) -> Column:
    """First run of digits as a double, ``default`` when there is none (C11)."""
    digits = F.regexp_substr(as_col(col), F.lit(r"\d+"))
    return F.coalesce(digits.try_cast("double"), F.lit(float(default)))
