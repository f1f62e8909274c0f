"""Join operators.

No join here is hinted to broadcast unless the small side has a bound by
construction; everything else is left to AQE, which converts a shuffle join
to a broadcast only after measuring the materialised side, and splits skewed
partitions of the preserved side.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import match_key

log = logging.getLogger("stockroom")


def _c(name: str):
    return F.col(f"`{name}`")


def left_join_nullsafe(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None,
                       null_safe: bool = True, skew_safe: bool = True,
                       warn_null_pairs: int | None = None) -> DataFrame:
    """Left outer equi-join on ``key``; right duplicates multiply rows.

    ``null_safe=True`` (default, the pandas merge rule) lets a null key match
    a null key; ``False`` gives SQL semantics. Non-key columns present on
    both sides are an error rather than suffixed.

    A left outer join lets AQE split only the left side of a hot key. With
    ``skew_safe`` (default) it is written as an inner join (AQE can split a
    hot key on either side) plus the left rows whose key has no match (an
    anti join against the right keys, deduplicated map-side), which is the
    same result. ``warn_null_pairs`` counts null keys on both sides (one
    extra aggregate each) and logs a warning when their product exceeds it.
    """
    right_key = right_key or key
    clash = (set(left.columns) & set(right.columns)) - {key, right_key}
    if clash:
        raise ValueError(f"non-key columns on both sides: {sorted(clash)}")
    r = right.withColumnRenamed(right_key, "_rk")
    if null_safe and warn_null_pairs is not None:
        nl = left.where(left[f"`{key}`"].isNull()).count()
        nr = right.where(F.col(f"`{right_key}`").isNull()).count()
        if nl * nr > warn_null_pairs:
            log.warning("null-key match will emit %d x %d rows", nl, nr)

    def cond(rk):
        lk = left[f"`{key}`"]
        return lk.eqNullSafe(rk) if null_safe else lk == rk

    if not skew_safe:
        return left.join(r, cond(r["_rk"]), "left").drop("_rk")
    if null_safe:
        # The columns that a null-safe match compares, as plain equi-join keys:
        # the distinct right keys are then partitioned as the join wants them,
        # and both joins share one exchange of the left rows.
        numeric = all(isinstance(t, NumericType) for t in (left.schema[key].dataType, r.schema["_rk"].dataType))
        lt, rt = _null_safe_key(left, key, "_l", numeric), _null_safe_key(r, "_rk", "_r", numeric)
        cols = list(zip(("_l0", "_l1"), ("_r0", "_r1")))
    else:
        lt, rt = left.withColumn("_l0", _c(key)), r.withColumn("_r0", F.col("_rk"))
        cols = [("_l0", "_r0")]
    on = reduce(and_, [F.col(x) == F.col(y) for x, y in cols])
    rnames = [y for _, y in cols]
    matched = lt.join(rt, on, "inner").drop("_rk", *rnames)
    unmatched = lt.join(rt.select(*rnames).distinct(), on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True).drop(*[x for x, _ in cols])


def _null_safe_key(df: DataFrame, key: str, name: str, numeric: bool) -> DataFrame:
    """``df`` with <name>0 (the key, a fixed value for null) and <name>1 (is it
    null): equal on both exactly where the keys are null-safe equal. Keys that
    are not numbers on both sides are compared as text."""
    value, fill = (_c(key), F.lit(0)) if numeric else (_c(key).cast("string"), F.lit(""))
    return df.withColumns({f"{name}0": F.coalesce(value, fill), f"{name}1": _c(key).isNull()})


def complete_domain(domain: DataFrame, agg: DataFrame, key: str, value: str, default=0) -> DataFrame:
    """Every domain key with its aggregated value, missing -> ``default``.

    Keys of ``agg`` outside the domain vanish.
    """
    return (domain.join(agg.select(_c(key), _c(value)), key, "left")
            .withColumn(value, F.coalesce(_c(value), F.lit(default))))


def _with_match_keys(df: DataFrame, keys: Sequence[str], collapse_inner: bool) -> tuple[DataFrame, list[str]]:
    names = [f"_mk{i}" for i in range(len(keys))]
    out = df
    for n, k in zip(names, keys):
        out = out.withColumn(n, match_key(_c(k), collapse_inner))
    return out, names


def split_matches(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("Item", "Comments"),
                  collapse_inner: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match incoming rows to existing ones by the C10 key of ``keys``.

    Returns (existing rows that some incoming row matches, incoming rows that
    match an existing row, incoming rows that match none).
    """
    ex, names = _with_match_keys(existing, keys, collapse_inner)
    inc, _ = _with_match_keys(incoming, keys, collapse_inner)
    ex_keys = ex.select(*names).distinct()
    inc_keys = inc.select(*names).distinct()
    touched = ex.join(inc_keys, names, "left_semi").drop(*names)
    found = inc.join(ex_keys, names, "left_semi").drop(*names)
    new = inc.join(ex_keys, names, "left_anti").drop(*names)
    return touched, found, new


def remove_rows(df: DataFrame, ids: DataFrame, id_col: str = "RowID") -> DataFrame:
    """Remove rows whose id appears in ``ids``."""
    return df.join(ids.select(_c(id_col)).distinct(), id_col, "left_anti")
