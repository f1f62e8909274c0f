"""Text column functions.

All are Catalyst expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# R's trimws() strips exactly these characters; its gsub("\\s+", " ") squish
# uses the regex class \s.
_TRIM_CHARS = "[ \\t\\r\\n]"
_TRIM_PATTERN = f"^{_TRIM_CHARS}+|{_TRIM_CHARS}+$"

# Fixed value: the phone-number pattern of the plan export, searched (not fully
# matched) in "Number / User Name".
PHONE_PATTERN = r"(\d{3}-\d{3}-\d{4})\s*(.*)"

# Fixed value: the id format of the +/- quantity buttons.
EVENT_PATTERN = r"^(plus|minus)_(\d+)$"


def trim_ws(col) -> Column:
    """Strip blanks, tabs and line breaks from both ends (R ``trimws``)."""
    return F.regexp_replace(as_col(col), _TRIM_PATTERN, "")


def squish(col) -> Column:
    """Trim both ends, then collapse inner whitespace runs to one blank."""
    return F.regexp_replace(trim_ws(col), r"\s+", " ")


def match_key(col, collapse_inner: bool = False) -> Column:
    """Comparison key that ignores case, outer blanks and null vs ''.

    ``collapse_inner`` also squishes inner runs of whitespace.
    """
    c = F.coalesce(as_col(col), F.lit(""))
    return F.lower(squish(c) if collapse_inner else trim_ws(c))


def split_phone(col) -> tuple[Column, Column]:
    """Split ``'803-555-0100  A. User'`` into (number, user name).

    Both are null when no number is found (a search, not a full match); the
    user name may be '' on a match.
    """
    c = as_col(col)
    # Group 1 is never empty on a match, so it doubles as the match test.
    found = F.regexp_extract(c, PHONE_PATTERN, 1)
    hit = found != ""
    return F.when(hit, found), F.when(hit, F.regexp_extract(c, PHONE_PATTERN, 2))


def dashes_to_dots(col) -> Column:
    return F.replace(as_col(col), F.lit("-"), F.lit("."))


def flag_contains(col, keyword: str, yes: str = "Y", no: str = "N") -> Column:
    """``yes`` when upper(col) contains ``keyword`` (already upper), else ``no``.

    Null input gives ``no``: a missing value does not contain the keyword.
    """
    return F.when(F.upper(as_col(col)).contains(keyword.upper()), yes).otherwise(no)


def parse_event(col) -> tuple[Column, Column]:
    """``plus_12`` -> (12, 1); ``minus_3`` -> (3, -1); anything else -> nulls."""
    c = as_col(col)
    kind = F.regexp_extract(c, EVENT_PATTERN, 1)
    row_id = F.when(kind != "", F.regexp_extract(c, EVENT_PATTERN, 2).try_cast("bigint"))
    delta = F.when(kind == "plus", F.lit(1)).when(kind == "minus", F.lit(-1))
    return row_id, delta


def slug(text: str, lower: bool = False) -> str:
    """Export-name slug of a label: blanks -> '_', optionally lower case."""
    s = text.replace(" ", "_")
    return s.lower() if lower else s


def slug_col(col, lower: bool = False) -> Column:
    c = F.replace(as_col(col), F.lit(" "), F.lit("_"))
    return F.lower(c) if lower else c
