from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def when_chain(pairs, otherwise=None, use_otherwise: bool = False) -> Column:
    """Fold ``[(condition, value), ...]`` into one ordered CASE WHEN.

    The first true condition wins, as in an ordered loop over rules.
    """
    pairs = list(pairs)
    if not pairs:
        return otherwise if use_otherwise else F.lit(None)
    expr = F.when(pairs[0][0], pairs[0][1])
    for cond, value in pairs[1:]:
        expr = expr.when(cond, value)
    return expr.otherwise(otherwise) if use_otherwise else expr
