"""Row identity, order-dependent selection, sorts, paging, unions
(SURVEY W1-W3, S1-S4, U1), plus the range-chunking used by ordered scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, IntegerType, LongType, MapType, ShortType, TimestampType,
                               VariantType)

from ..functions._util import as_col
from ..session import default_parallelism, write_once

# Fixed value: the pseudonym prefix of anonymised names.
PSEUDONYM_PREFIX = "User "

# monotonically_increasing_id() = partition index << 33 | position in partition
_POS_MASK = (1 << 33) - 1


def _orderable(df: DataFrame, exclude: Sequence[str]) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields
            if f.name not in exclude and not isinstance(f.dataType, (MapType, VariantType))]


def with_chunks(df: DataFrame, keys: Sequence, order_cols: Sequence, name: str = "_chunk",
                num_partitions: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and tag each row with its partition.

    Partitions hold contiguous, ordered slices of the (keys, order) sequence,
    so a key with a third of all rows is spread over many chunks instead of
    one task. Scans then run per (key, chunk) and carry a small per-chunk
    summary across chunks (see ``changes.running_quantity``).
    """
    n = num_partitions or default_parallelism(df.sparkSession)
    return (df.repartitionByRange(n, *[as_col(c) for c in keys], *[as_col(c) for c in order_cols])
            .withColumn(name, F.spark_partition_id()))


# Sampled rows per bucket: a key with as many sampled rows is cut into buckets.
_SAMPLED = 64


def with_buckets(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], num_buckets: int | None = None) -> DataFrame:
    """Tag each row with ``_bucket``, a stretch of its key's order, and
    ``_split``, whether its key has several.

    A key with a good part of all rows is cut into stretches of about
    1/``num_buckets`` of all rows; every other key is one stretch. The bounds
    are quantiles of a hash sample of (key, order), taken once and written:
    whatever is recomputed later sees the same buckets. Rows do not move here;
    a scan per (key, bucket) moves them once, by hash, and carries one summary
    per bucket of the cut keys, of which there are about ``num_buckets``.
    """
    spark = df.sparkSession
    n = num_buckets or default_parallelism(spark)
    order = F.struct(*[F.col(f"`{c}`") for c in order_cols])
    narrow = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], order.alias("_o"))
    ids = [f"_k{i}" for i in range(len(keys))]
    drawn = F.pmod(F.xxhash64(*ids, "_o"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, _SAMPLED * n / max(1, df.count()))))
    # At most about _SAMPLED * n rows, so every list and the table are bounded.
    cut = F.filter(F.array_sort(F.collect_list("_o")), lambda _, i: i % _SAMPLED == _SAMPLED - 1)
    bounds = write_once(narrow.where(drawn).groupBy(*ids).agg(cut.alias("_bounds")).where(F.size("_bounds") > 0), "order-bounds")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    tagged = df.join(F.broadcast(bounds), same, "left")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((2 * n).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get("_bounds", low + step - 1) <= order, F.lit(False)), low + step).otherwise(low))
    return (tagged.withColumn("_split", F.col("_bounds").isNotNull())
            .withColumn("_bucket", F.when(F.col("_split"), at).otherwise(0)).drop("_bounds", *ids))


def with_row_id(df: DataFrame, order_cols: Sequence, name: str = "RowID", start: int = 1,
                num_partitions: int | None = None, unique: bool = False) -> DataFrame:
    """Dense global index in ``order_cols`` order, starting at ``start``.

    Two passes and no single-task step: range-partition and sort, count rows
    per partition (one row per partition), turn the counts into offsets, and
    add each row's position in its partition. Both passes must see the same
    partitions: the sorted input is written once under the shared
    ``spark.checkpoint.dir``, which also cuts the lineage and leaves nothing
    cached on the executors; the count reads one column of it. Remaining columns break ties. ``unique=True``
    states that ``order_cols`` never tie, and skips the tie-break columns.
    """
    n = num_partitions or default_parallelism(df.sparkSession)
    order = [as_col(c) for c in order_cols]
    order_names = [c for c in order_cols if isinstance(c, str)]
    full = order if unique else [*order, *_orderable(df, order_names)]
    # Ranges over the full order, so rows sharing a hot order value can land
    # in several partitions instead of one.
    ranged = (df.repartitionByRange(n, *full)
              .sortWithinPartitions(*full)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    ranged = write_once(ranged, "row-ids")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per partition: a bounded table, safe to order globally
    # and to broadcast.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos") + F.lit(start))
            .drop("_pid", "_pos", "_off"))


def anonymise(df: DataFrame, col: str, order_cols: Sequence, clearance: str | None = None,
              prefix: str = PSEUDONYM_PREFIX, unique: bool = False) -> DataFrame:
    """Replace ``col`` by ``'User 0'..'User n-1'`` in row order unless the
    clearance is ``'high'`` (W2). Every row gets its own label."""
    if clearance == "high":
        return df
    cols = df.columns
    numbered = with_row_id(df, order_cols, name="_user_no", start=0, unique=unique)
    return numbered.withColumn(col, F.concat(F.lit(prefix), F.col("_user_no").cast("string"))).select(
        *[F.col(f"`{c}`") for c in cols])


# Two 63-bit numbers in one decimal(38,0): the first decides, then the second.
_ROW_SPAN = Decimal(1 << 63)


def _fixed_width(df: DataFrame, col: Column) -> Column | None:
    """An order column as a 64-bit number, if its type is of fixed width."""
    kind = df.select(col.alias("o")).schema["o"].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType, BooleanType)):
        return col.cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(col).cast("long")
    return F.unix_micros(col) if isinstance(kind, TimestampType) else None


def first_row_no(df: DataFrame, tiers: Sequence[Sequence[Column]], row_no: str = "_row_no") -> Column:
    """Aggregate: the number of the first row. The first tier that any row of
    the group has a value in decides, by its smallest value and then the
    smallest row number; with none, the smallest row number does.

    One order column of fixed width is packed with the row number into one
    decimal, so the aggregate is a hash aggregate; other orders are compared
    as narrow structs.
    """
    number, picked = F.col(row_no), []
    for tier in tiers:
        one = _fixed_width(df, tier[0]) if len(tier) == 1 else None
        if one is not None:
            packed = one.cast("decimal(20,0)") * F.lit(_ROW_SPAN) + number.cast("decimal(19,0)")
            picked.append(F.pmod(F.min(packed), F.lit(_ROW_SPAN).cast("decimal(38,0)")).cast("long"))
        else:
            given = tier[0].isNotNull() if len(tier) == 1 else F.lit(True)
            picked.append(F.min_by(F.when(given, number), F.when(given, F.struct(*tier, number))))
    return F.coalesce(*picked, F.min(number))


def numbered_rows(df: DataFrame, label: str, row_no: str = "_row_no") -> DataFrame:
    """Rows with a number each, written once: every later pass sees the same
    numbers. No row is moved for it."""
    return write_once(df.withColumn(row_no, F.monotonically_increasing_id()), label)


def first_rows(df: DataFrame, keys: Sequence[str], tiers: Sequence[Sequence[Column]], carry: Sequence[str],
               aggs: Sequence[Column] = ()) -> DataFrame:
    """Per key: the key, the aggregates and the ``carry`` columns of its first
    row. Only keys, order and numbers are aggregated, with map-side partials;
    the winners fetch their other columns by row number, so that neither a
    wide row is sorted nor a hot key moved for losing."""
    rows = numbered_rows(df, "first-rows")
    winners = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first_row_no(rows, tiers).alias("_row_no"), *aggs)
    more = [F.col(f"`{c}`") for c in carry if c not in keys]
    if not more:
        return winners.drop("_row_no")
    return winners.join(rows.select("_row_no", *more), "_row_no").drop("_row_no")


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence) -> DataFrame:
    """The first row of each key in ``order_cols`` order (W3); rows without
    an order value come last, ties go by their place in the table."""
    others = [c for c in df.columns if c not in keys]
    return first_rows(df, keys, [[as_col(c) for c in order_cols]], others).select(*[F.col(f"`{c}`") for c in df.columns])


def sort_view(df: DataFrame, keys: Sequence[str] = ("Section", "Item"),
              tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Sort by text keys ascending, nulls last.

    Ties are broken by ``tiebreak`` (the row position, for R's stable sort)
    or else by the remaining columns: the global sort then ranges over
    distinct values, so one hot (Section, Item) is not sorted by one task.
    """
    rest = [F.col(f"`{c}`") for c in tiebreak] if tiebreak is not None else _orderable(df, keys)
    return df.orderBy(*[F.asc_nulls_last(F.col(f"`{k}`")) for k in keys], *rest)


def rank_groups(df: DataFrame, measure: str, key: str, top_k: int | None = None) -> DataFrame:
    """Groups by measure descending, key ascending; optional top-k."""
    out = df.orderBy(F.desc(F.col(f"`{measure}`")), F.asc(F.col(f"`{key}`")))
    return out.limit(top_k) if top_k else out


def search_filter(df: DataFrame, search: str | None) -> DataFrame:
    """Keep rows where any column, as lower-case text, contains ``search``."""
    if not search:
        return df
    s = search.lower()
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(s), F.lit(False))
    return df.where(hit)


def table_page(df: DataFrame, search: str | None = None, sort: Sequence[tuple[str, bool]] = (),
               page: int = 0, size: int = 10, hidden: Sequence[str] = ()) -> DataFrame:
    """Server-side table view: drop hidden columns, search, sort, one page.

    ``sort`` is ``[(column, ascending), ...]``; it should end in a unique
    column so pages do not overlap. Sort + offset + limit plans as a top-k.
    """
    view = search_filter(df.drop(*hidden), search)
    if sort:
        view = view.orderBy(*[(F.asc_nulls_last if asc else F.desc_nulls_last)(F.col(f"`{c}`"))
                              for c, asc in sort])
    return view.offset(page * size).limit(size)


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append by column name; columns missing on one side become null."""
    return a.unionByName(b, allowMissingColumns=True)
