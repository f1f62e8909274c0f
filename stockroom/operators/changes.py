"""Table changes: duplicate merging, upserts and quantity events
(SURVEY G5, G6, I1, I2, I5, W4).

Order-dependent choices ("the first row wins") follow an explicit order, never
``first()``. Ordered scans over events are split into buckets of the order, so
one hot row id never becomes one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import DEFAULT_SECTION_GROUPS, combine_sections
from ..functions.text import parse_event, squish, trim_ws
from ..session import ensure_checkpoint_dir
from .aggregate import next_row_id
from .filters import validate_items
from .joins import _with_match_keys
from .ordering import first_row_no, first_rows, numbered_rows, with_buckets, with_row_id


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _sum_strict(col: str) -> tuple[Column, Column]:
    """(sum ignoring nulls, number of nulls): R ``sum`` without ``na.rm``."""
    return F.sum(_c(col)), F.count_if(_c(col).isNull())


# ---------------------------------------------------------------------------
# Duplicate merging
# ---------------------------------------------------------------------------

def _collapse_exact(df: DataFrame, tiers: Sequence[Sequence[Column]], keys: Sequence[str], qty: str,
                    carry: Sequence[str]) -> DataFrame:
    carry = [c for c in carry if c in df.columns and c not in keys]
    total = F.coalesce(F.sum(_c(qty)), F.lit(0)).cast("bigint").alias(qty)
    return first_rows(df, keys, tiers, carry, [total]).select(*[_c(k) for k in keys], _c(qty), *[_c(c) for c in carry])


def collapse_exact(df: DataFrame, order_col, keys: Sequence[str] = ("Item", "Comments"),
                   qty: str = "Quantity", carry: Sequence[str] = ("Section", "Combined_Section")) -> DataFrame:
    """Merge rows with exactly equal keys over the whole table.

    Quantity is summed ignoring nulls (all null -> 0); ``carry`` columns come
    from the first row in ``order_col`` order. Null and '' are different
    keys. Other columns are dropped, as a dplyr summarise does.
    """
    order = order_col if isinstance(order_col, Column) else _c(order_col)
    return _collapse_exact(df, [[order]], keys, qty, carry)


def collapse_items(df: DataFrame, order_col: str = "RowID", keys: Sequence[str] = ("Item", "Comments"),
                   qty: str = "Quantity", collapse_inner: bool = False) -> DataFrame:
    """Merge rows whose keys are equal ignoring case, outer blanks and
    null vs '' (G6). The first row in ``order_col`` order keeps all its
    columns; its quantity becomes the group sum (null if any is null)."""
    keyed, names = _with_match_keys(df, keys, collapse_inner)
    s, nulls = _sum_strict(qty)
    agg = first_rows(keyed, names, [[_c(order_col)]], [c for c in df.columns if c != qty], [s.alias("_q"), nulls.alias("_n")])
    total = F.when(F.col("_n") > 0, F.lit(None)).otherwise(F.col("_q")).cast("bigint")
    return agg.withColumn(qty, total).select(*[_c(c) for c in df.columns])


# ---------------------------------------------------------------------------
# Upserts
# ---------------------------------------------------------------------------

def prepare_incoming(existing: DataFrame, incoming: DataFrame, price_col: str = "Estimated Price",
                     section_col: str = "Section", groups=DEFAULT_SECTION_GROUPS,
                     keys: Sequence[str] = ("Item", "Comments")) -> tuple[DataFrame, DataFrame]:
    """Validate (B12), squish the key texts (C9) and categorise (C1) incoming
    items. Returns (accepted, rejected)."""
    has_price = price_col in existing.columns
    accepted, rejected = validate_items(incoming, keys[0], price_col if has_price else None)
    for k in keys:
        accepted = accepted.withColumn(k, squish(_c(k)))
    if "Combined_Section" in existing.columns:
        accepted = accepted.withColumn("Combined_Section", combine_sections(_c(section_col), groups))
    if has_price and price_col in accepted.columns:
        accepted = accepted.withColumn(price_col, _c(price_col).cast("double"))
    else:
        accepted = accepted.drop(price_col)
    return accepted, rejected


def upsert_items(existing: DataFrame, incoming: DataFrame, order_col: str = "RowID", arrival_col: str = "seq",
                 keys: Sequence[str] = ("Item", "Comments"), qty: str = "Quantity",
                 price_col: str = "Estimated Price", section_col: str = "Section",
                 groups=DEFAULT_SECTION_GROUPS, collapse_inner: bool = False) -> DataFrame:
    """The table of ``upsert_with_rejects``."""
    return upsert_with_rejects(existing, incoming, order_col, arrival_col, keys, qty, price_col, section_col, groups,
                               collapse_inner)[0]


def upsert_with_rejects(existing: DataFrame, incoming: DataFrame, order_col: str = "RowID", arrival_col: str = "seq",
                        keys: Sequence[str] = ("Item", "Comments"), qty: str = "Quantity",
                        price_col: str = "Estimated Price", section_col: str = "Section",
                        groups=DEFAULT_SECTION_GROUPS, collapse_inner: bool = False,
                        id_table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge a batch of incoming items into an inventory table (I1). Returns
    (table, rejected rows with their reason). New ids follow the largest of
    ``id_table`` (default: the table itself).

    Per key (C10 of ``keys``; the section is ignored) touched by an accepted
    incoming row: the first existing row keeps all its columns and gets the
    sum of all existing and incoming quantities, other existing matches are
    dropped; with no existing match the first incoming row is appended with
    the incoming sum and a new id (max + 1 upwards, in arrival order).
    Untouched rows stay as they are. A null quantity makes its key's sum null.
    ``order_col`` is the row's id; rows without one come last, and rows that
    share one follow their place in the table.
    """
    accepted, rejected = prepare_incoming(existing, incoming, price_col, section_col, groups, keys)
    # Ids may be null or repeated: rows are found by numbers of their own,
    # written once, so that all uses see the same; no row is moved for it.
    ex, names = _with_match_keys(numbered_rows(existing, "upsert-rows"), keys, collapse_inner)
    inc, _ = _with_match_keys(numbered_rows(accepted, "upsert-incoming", "_inc_no"), keys, collapse_inner)

    # Both sides are reduced to one narrow row per key, with map-side partials,
    # before they meet: no row of a hot key is aggregated after a join.
    inc_cols = [c for c in accepted.columns if c not in (qty, arrival_col)]
    is_, in_ = _sum_strict(qty)
    inc_agg = inc.groupBy(*names).agg(first_row_no(inc, [[_c(arrival_col)]], "_inc_no").alias("_inc_no"),
                                      F.min(_c(arrival_col)).alias("_arr"), is_.alias("_iq"), in_.alias("_in"))
    es, en = _sum_strict(qty)
    ex_agg = ex.groupBy(*names).agg(first_row_no(ex, [[_c(order_col)]]).alias("_keep"), es.alias("_eq"), en.alias("_en"),
                                    F.lit(True).alias("_found"))
    ensure_checkpoint_dir(existing.sparkSession)
    changed = inc_agg.join(ex_agg, names, "left").checkpoint()

    # The first existing row of a changed key takes the sum, its other rows go.
    total = F.when(F.col("_en") + F.col("_in") > 0, F.lit(None)).otherwise(
        F.coalesce(F.col("_eq"), F.lit(0)) + F.coalesce(F.col("_iq"), F.lit(0)))
    sums = changed.where(F.col("_found")).select(*names, "_keep", "_found", total.alias("_total"))
    present = (ex.join(sums, names, "left")
               .where(F.col("_found").isNull() | (F.col("_row_no") == F.col("_keep")))
               .withColumn(qty, F.when(F.col("_found"), F.col("_total")).otherwise(_c(qty))))

    # Numbered while narrow: arrival and row number are distinct per key, so no ties.
    new = with_row_id(changed.where(F.col("_found").isNull()).select("_inc_no", "_arr", "_iq", "_in"), ["_arr", "_inc_no"],
                      name="_new_no", start=0, unique=True)
    appended = new.join(inc.select("_inc_no", *[_c(c) for c in inc_cols if c != order_col]), "_inc_no").select(
        *[_c(c) for c in inc_cols if c != order_col],
        F.when(F.col("_in") > 0, F.lit(None)).otherwise(F.col("_iq")).alias(qty),
        (next_row_id(existing if id_table is None else id_table, order_col) + F.col("_new_no")).alias(order_col))

    schema = {f.name: f.dataType for f in existing.schema.fields}
    out = present.select(*[_c(c) for c in existing.columns]).unionByName(appended, allowMissingColumns=True)
    return out.select(*[_c(c).cast(schema[c]).alias(c) for c in existing.columns]), rejected


def append_and_collapse(existing: DataFrame, incoming: DataFrame, order_col: str = "RowID",
                        arrival_col: str = "seq", keys: Sequence[str] = ("Item", "Comments"),
                        qty: str = "Quantity", section_col: str = "Section",
                        groups=DEFAULT_SECTION_GROUPS) -> DataFrame:
    """CSV-variant add (I2): trim the new rows, append them, then merge exact
    duplicates over the whole table (G5). No validation."""
    inc = incoming
    for k in keys:
        inc = inc.withColumn(k, trim_ws(_c(k)))
    inc = inc.withColumn("Combined_Section", combine_sections(_c(section_col), groups))
    ex = existing if "Combined_Section" in existing.columns else existing.withColumn(
        "Combined_Section", combine_sections(_c(section_col), groups))
    both = (ex.withColumns({"_pos": _c(order_col).cast("bigint"), "_old": F.lit(0)})
            .unionByName(inc.withColumn("_late", _c(arrival_col).cast("bigint")), allowMissingColumns=True))
    # Existing rows come before new ones, each in their own order.
    return _collapse_exact(both, [[F.col("_pos")], [F.col("_old")], [F.col("_late")]], keys, qty,
                           (section_col, "Combined_Section"))


# ---------------------------------------------------------------------------
# Quantity events
# ---------------------------------------------------------------------------

def _bucket_offsets(rows: DataFrame, id_col: str, delta_col: str) -> DataFrame:
    """Per bucket of the ids that are cut into several: the sum of the id's
    earlier buckets. About as many rows as there are buckets."""
    sums = rows.where("_split").groupBy(_c(id_col).alias("_oid"), F.col("_bucket").alias("_obucket")).agg(
        F.sum(_c(delta_col)).alias("_s"))
    before = Window.partitionBy("_oid").orderBy("_obucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_oid", "_obucket", F.sum("_s").over(before).alias("_off")))


def _local_scan(rows: DataFrame, id_col: str, delta_col: str, order_cols: Sequence[str]) -> DataFrame:
    """Running sum within each (id, bucket): the one exchange of the rows."""
    w = (Window.partitionBy(_c(id_col), F.col("_bucket")).orderBy(*[_c(c) for c in order_cols])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_local", F.sum(_c(delta_col)).over(w))


def _with_offset(rows: DataFrame, offsets: DataFrame, id_col: str) -> DataFrame:
    same = _c(id_col).eqNullSafe(F.col("_oid")) & (F.col("_bucket") == F.col("_obucket"))
    return rows.join(offsets, same, "left").withColumn("_off", F.coalesce("_off", F.lit(0)))


def running_quantity(events: DataFrame, id_col: str = "row_id", delta_col: str = "delta",
                     order_cols: Sequence[str] = ("ts", "event_id"), name: str = "running",
                     num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``delta`` per id in event order.

    Equal to ``sum(delta) over (partition by id order by ... rows unbounded
    preceding)``, computed as a local scan per (id, bucket of its order) plus
    the sum of the id's earlier buckets. The events are shuffled once.
    """
    rows = with_buckets(events, [id_col], order_cols, num_partitions)
    local = _with_offset(_local_scan(rows, id_col, delta_col, order_cols), _bucket_offsets(rows, id_col, delta_col), id_col)
    return local.withColumn(name, F.col("_off") + F.col("_local")).select(
        *[_c(c) for c in events.columns if c != name], _c(name))


def net_and_floor(events: DataFrame, id_col: str = "row_id", delta_col: str = "delta",
                  order_cols: Sequence[str] = ("ts", "event_id"),
                  num_partitions: int | None = None) -> DataFrame:
    """Per id: net change and the lowest running change seen right after a
    negative event (null when there is none). The events are shuffled once,
    by (id, bucket); one summary per id and bucket follows."""
    rows = with_buckets(events, [id_col], order_cols, num_partitions)
    summ = _local_scan(rows, id_col, delta_col, order_cols).groupBy(_c(id_col), F.col("_bucket")).agg(
        F.sum(_c(delta_col)).alias("_sum"), F.min(F.when(_c(delta_col) < 0, F.col("_local"))).alias("_m"))
    return (_with_offset(summ, _bucket_offsets(rows, id_col, delta_col), id_col).groupBy(_c(id_col))
            .agg(F.sum("_sum").alias("_net"), F.min(F.col("_off") + F.col("_m")).alias("_floor")))


def apply_quantity_events(df: DataFrame, events: DataFrame, id_col: str = "RowID", qty: str = "Quantity",
                          event_id_col: str = "row_id", delta_col: str = "delta",
                          order_cols: Sequence[str] = ("ts", "event_id"),
                          num_partitions: int | None = None) -> DataFrame:
    """Apply +1/-1 quantity events to a table (I5, covering I3 and I4).

    Events of one id apply in order; the row is deleted as soon as a negative
    event brings its quantity to 0 or below, and later events for it are
    ignored. Unknown ids are ignored; a null quantity stays null.
    """
    summary = net_and_floor(events, event_id_col, delta_col, order_cols, num_partitions)
    return apply_net_and_floor(df, summary, id_col, qty, event_id_col)


def apply_net_and_floor(df: DataFrame, summary: DataFrame, id_col: str = "RowID", qty: str = "Quantity",
                        event_id_col: str = "row_id") -> DataFrame:
    """Apply the events that ``net_and_floor`` sums up per id to a table."""
    summary = summary.withColumnRenamed(event_id_col, "_eid")
    joined = df.join(summary, df[f"`{id_col}`"] == summary["_eid"], "left")
    q = _c(qty)
    gone = F.coalesce(q + F.col("_floor") <= 0, F.lit(False))
    kept = joined.where(~gone).withColumn(
        qty, F.when(F.col("_net").isNull(), q).otherwise(q + F.col("_net")).cast(df.schema[qty].dataType))
    return kept.select(*[_c(c) for c in df.columns])


def apply_buttons(df: DataFrame, clicks: DataFrame, button_col: str = "button", id_col: str = "RowID",
                  qty: str = "Quantity", order_cols: Sequence[str] = ("ts", "event_id"),
                  num_partitions: int | None = None) -> DataFrame:
    """I3 and I4 from button clicks: parse ``plus_<id>`` / ``minus_<id>``
    (C15; anything else is ignored) and apply them in order (I5)."""
    row_id, delta = parse_event(_c(button_col))
    events = (clicks.select(*[_c(c) for c in order_cols], row_id.alias("_bid"), delta.alias("_bdelta"))
              .where(F.col("_bdelta").isNotNull()))
    return apply_quantity_events(df, events, id_col=id_col, qty=qty, event_id_col="_bid", delta_col="_bdelta",
                                 order_cols=order_cols, num_partitions=num_partitions)
