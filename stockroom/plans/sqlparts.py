"""DuckDB SQL fragments that mirror the column functions, for oracle queries.

Oracle-only: the Spark side never runs these strings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..functions.money import _NUMERIC

_TRIM = "'^[ \\t\\r\\n]+|[ \\t\\r\\n]+$'"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {_TRIM}, '', 'g')"


def squish(x: str) -> str:
    return f"regexp_replace({trim_ws(x)}, '\\s+', ' ', 'g')"


def key(x: str) -> str:
    return "lower(" + trim_ws(f"coalesce({x}, '')") + ")"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def combine(x: str, groups: Sequence[tuple[str, Sequence[str]]]) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(lit(m) for m in members)}) THEN {lit(name)}"
                     for name, members in groups)
    return f"CASE {whens} ELSE {x} END"


def money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


def parse_money(x: str) -> str:
    s = f"regexp_replace(CAST({x} AS VARCHAR), '[$,]', '', 'g')"
    return f"CASE WHEN regexp_matches({s}, {lit(_NUMERIC)}) THEN TRY_CAST(trim({s}) AS DOUBLE) END"


def price_rules(x: str, rules: Sequence[tuple[str, float]], clean: bool = True, default=0) -> str:
    text = "upper(" + trim_ws(f"replace({x}, 'GS', 'S')") + ")" if clean else f"upper({x})"
    whens = []
    for k, p in rules:
        if not re.fullmatch(r"[A-Z0-9 ]+", k.upper()):
            raise ValueError(f"oracle keyword needs escaping: {k!r}")
        whens.append(f"WHEN regexp_matches({text}, {lit('\\b' + k.upper() + '\\b')}) THEN {float(p)}")
    return f"CAST(CASE {' '.join(whens)} ELSE {float(default)} END AS DOUBLE)"


def first_number(x: str, default: float = 100.0) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '\\d+', 0), '') AS DOUBLE), {float(default)})"


def money_sum(x: str) -> str:
    return f"CAST(CAST(sum(CAST({x} AS DECIMAL(38,10))) AS DECIMAL(38,4)) AS DOUBLE)"


def money_product_sum(a: str, b: str) -> str:
    return f"CAST(CAST(sum(CAST(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) AS DECIMAL(38,10))) AS DECIMAL(38,4)) AS DOUBLE)"
