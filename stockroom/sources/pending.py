"""What streams add to a snapshot version, without rewriting it.

Under ``<root>/<name>/pending/base=<N>`` (N: the version added to, or none):

- ``rows/seq=<K>``: rows of a keyed result (T1, T2). Each trigger writes the
  keys it changed; the newest row of a key counts.
- ``log/stream=<id>/batch=<B>``: quantity events (T3) with their time slot.
- ``sums/seq=<K>``: per (id, slot) the sum of the events and the lowest running
  sum at a negative one. Those that a batch touches are computed again from
  the log, so an event that comes late counts at its own time.

Every folder is plain Parquet, and written again when a micro-batch is
replayed: the same rows in the same place, or newer equal ones. A new version
starts with an empty pending folder; what it holds is in its ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..operators.changes import apply_net_and_floor, net_and_floor
from ..session import write_once
from .sinks import (_fs, _latest, applied_batches, delete_path, path_exists, prune_snapshots, read_snapshot,
                    write_snapshot)

_META = ["_id_col", "_qty"]


def _folder(root: str, name: str, base: int | None) -> str:
    return f"{root.rstrip('/')}/{name}/pending/base={'none' if base is None else base}"


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete ``<prefix>=<K>`` folders under a path."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [st.getPath() for st in fs.listStatus(p)]
    return sorted(int(n.getName().split("=")[1]) for n in names
                  if n.getName().startswith(f"{prefix}=") and fs.exists(jpath(n, "_SUCCESS")))


def _next_seq(spark: SparkSession, path: str) -> int:
    numbers = _numbers(spark, path, "seq")
    return numbers[-1] + 1 if numbers else 0


def _complete(spark: SparkSession, path: str) -> DataFrame | None:
    """The complete ``seq=<K>`` folders under a path, with their ``seq``."""
    numbers = _numbers(spark, path, "seq")
    if not numbers:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/seq={k}" for k in numbers])


# ---------------------------------------------------------------------------
# Keyed rows
# ---------------------------------------------------------------------------

def add_rows(batch: DataFrame, root: str, name: str, key: str, fold_every: int, keep_versions: int | None = None) -> None:
    """Write the changed rows of a keyed result. Every ``fold_every`` triggers
    the state is folded into a new version, and old versions go."""
    spark = batch.sparkSession
    base = _latest(spark, root, name)
    rows = f"{_folder(root, name, base)}/rows"
    seq = _next_seq(spark, rows)
    batch.withColumn("_key_col", F.lit(key)).write.mode("overwrite").parquet(f"{rows}/seq={seq}")
    if seq + 1 >= fold_every:
        write_snapshot(read_snapshot(spark, root, name), root, name, base=base)
        clear_pending(spark, root, name, base)
        prune_snapshots(spark, root, name, keep_versions or 2)


def _with_rows(base: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """Newest row per key over the rows of the version. Values are of fixed
    width, so the newest is found by a narrow aggregate per key."""
    k = F.col(f"`{key}`")
    values = [c for c in rows.columns if c not in (key, "seq", "_key_col")]
    newest = rows.groupBy(k).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in values]), "seq").alias("_v")).select(
        k, *[F.col("_v")[c].alias(c) for c in values])
    if base is None:
        return newest
    changed = newest.select(k.alias("_changed"))
    return base.join(changed, k.eqNullSafe(F.col("_changed")), "left_anti").unionByName(newest)


# ---------------------------------------------------------------------------
# Quantity events
# ---------------------------------------------------------------------------

def slot_of(df: DataFrame, col: str, width: int) -> Column:
    """Number of the stretch of ``width`` seconds (days for dates: as many
    seconds) or units in which an order value lies."""
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, TimestampType):
        c = F.unix_micros(c) / 1_000_000
    elif isinstance(kind, TimestampNTZType):
        c = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
    elif isinstance(kind, DateType):
        c = F.unix_date(c).cast("long") * 86_400
    return F.coalesce(F.floor(c / width).cast("long"), F.lit(0).cast("long"))


def add_events(batch: DataFrame, stream: str, batch_id: int, root: str, name: str, order_cols: Sequence[str],
               id_col: str, qty: str, event_id_col: str, delta_col: str, slot_width: int) -> None:
    """Log a micro-batch of events and sum up the (id, slot) pairs it touches.
    A batch that the version's ledger holds is passed over."""
    spark = batch.sparkSession
    base = _latest(spark, root, name)
    if base is None:
        raise FileNotFoundError(f"no snapshot of {name} under {root}; write the starting table first")
    if applied_batches(spark, root, name, base).get(stream, -1) >= batch_id:
        return
    folder = _folder(root, name, base)
    log, mine = f"{folder}/log", f"{folder}/log/stream={stream}/batch={batch_id}"
    events = batch.select(*[F.col(f"`{c}`") for c in order_cols], F.col(f"`{event_id_col}`").alias("_id"),
                          F.col(f"`{delta_col}`").alias("_delta"), slot_of(batch, order_cols[0], slot_width).alias("slot"))
    events.sortWithinPartitions("slot").write.mode("overwrite").parquet(mine)
    spark_log = spark.read.option("basePath", log).schema(_with_types(events)).parquet(log)
    batch_log = spark.read.schema(events.schema).parquet(mine)
    touched = batch_log.select("_id", "slot").distinct()
    # The batch's first and last slot: file statistics skip the log's other files.
    span = batch_log.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    again = spark_log.where(F.col("slot").between(span.a, span.b)).join(touched, ["_id", "slot"], "left_semi")
    keyed = write_once(again.withColumn("_key", F.struct("_id", "slot")), "touched-events")
    sums = net_and_floor(keyed, "_key", "_delta", order_cols)
    # At least one row, so that the folder tells its types.
    out = sums.select(F.col("_key._id").alias("_id"), F.col("_key.slot").alias("_slot"), "_net", "_floor",
                      F.lit(id_col).alias("_id_col"), F.lit(qty).alias("_qty"))
    out.write.mode("overwrite").parquet(f"{folder}/sums/seq={_next_seq(spark, f'{folder}/sums')}")


def _with_types(events: DataFrame):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return StructType([*events.schema.fields, StructField("stream", StringType()), StructField("batch", LongType())])


def _with_sums(base: DataFrame, sums: DataFrame, id_col: str, qty: str) -> DataFrame:
    """The version with its events applied: the slots of an id in time order."""
    newest = sums.groupBy("_id", "_slot").agg(F.max(F.struct("seq", "_net", "_floor")).alias("_s")).select(
        "_id", "_slot", "_s._net", "_s._floor")
    before = Window.partitionBy("_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    at = newest.withColumn("_off", F.coalesce(F.sum("_net").over(before), F.lit(0)))
    whole = at.groupBy("_id").agg(F.sum("_net").alias("_net"), F.min(F.col("_off") + F.col("_floor")).alias("_floor"))
    return apply_net_and_floor(base, whole, id_col, qty, "_id")


# ---------------------------------------------------------------------------
# Reading and folding
# ---------------------------------------------------------------------------

def with_pending(spark: SparkSession, root: str, name: str, version: int | None, base: DataFrame | None) -> DataFrame | None:
    """A version (or none) with what is pending on it."""
    folder = _folder(root, name, version)
    if not path_exists(spark, folder):
        return base
    rows = _complete(spark, f"{folder}/rows")
    if rows is not None:
        key = rows.select("_key_col").first()
        if key is not None:
            base = _with_rows(base, rows, key[0])
        elif base is None:
            base = rows.drop("seq", "_key_col")
    sums = _complete(spark, f"{folder}/sums")
    meta = sums.select(*_META).first() if sums is not None else None
    return base if meta is None else _with_sums(base, sums, *meta)


def pending_batches(spark: SparkSession, root: str, name: str, version: int | None) -> dict[str, int]:
    """Last batch per stream among the events pending on a version."""
    log = f"{_folder(root, name, version)}/log"
    fs, p = _fs(spark, log)
    if not fs.exists(p):
        return {}
    streams = [st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().startswith("stream=")]
    held = {s.split("=", 1)[1]: _numbers(spark, f"{log}/{s}", "batch") for s in streams}
    return {s: n[-1] for s, n in held.items() if n}


def clear_pending(spark: SparkSession, root: str, name: str, version: int | None) -> None:
    """Delete what was pending on a version that a newer one has taken in."""
    delete_path(spark, _folder(root, name, version))


def fold_pending(spark: SparkSession, root: str, name: str) -> int | None:
    """Write the state with all that is pending as the next version."""
    base = _latest(spark, root, name)
    version = write_snapshot(read_snapshot(spark, root, name), root, name, base=base,
                             applied=pending_batches(spark, root, name, base))
    clear_pending(spark, root, name, base)
    return version
