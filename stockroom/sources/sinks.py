"""Table sinks and versioned snapshots.

A snapshot is a folder ``<root>/<name>/v=<N>`` of plain Parquet, complete when
Spark's ``_SUCCESS`` is there; readers take the highest complete N. Spark
cannot overwrite a path it is reading from, so a change is always the next
version. A table has one writer at a time; a version that appeared since the
base was read is refused with ``SnapshotConflict``.

Streams add to a version without rewriting it: see ``pending``. The ledger
``<root>/<name>/ledger/v=<N>``, written before the version, is a Parquet table
of the last batch of every stream that the version holds: what is replayed is
anti-joined with it.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import slug

_VERSION = re.compile(r"^v=(\d+)$")

# File names of exported views. {date} is ISO, {label} is the
# filter value with blanks as '_' (lower case for workstations, as is
# {category}).
EXPORT_NAME_FORMATS = {
    "inventory": "inventory-{date}.csv",
    "phone": "phone_data_{label}.csv",
    "server": "server_data_{label}.csv",
    "workstation": "{category}_{label}_data.csv",
}


def write_csv(df: DataFrame, path: str, style: str = "pandas", single_file: bool = False,
              mode: str = "errorifexists") -> None:
    """CSV with a header and no index.

    pandas writes null as an empty field, readr as ``NA``. ``single_file``
    coalesces to one task and is meant for small exports only.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("nullValue", "NA" if style == "readr" else "").option("emptyValue", "")
     .csv(path))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshot_versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Committed versions of a snapshot table (listing of one folder)."""
    fs, base = _fs(spark, f"{root.rstrip('/')}/{name}")
    if not fs.exists(base):
        return []
    versions = []
    for st in fs.listStatus(base):
        m = _VERSION.match(st.getPath().getName())
        if m and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            versions.append(int(m.group(1)))
    return sorted(versions)


class SnapshotConflict(RuntimeError):
    """The version to be written exists, or another one appeared meanwhile."""


_LEDGER = "stream string, batch long"


def _latest(spark: SparkSession, root: str, name: str) -> int | None:
    versions = snapshot_versions(spark, root, name)
    return versions[-1] if versions else None


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_ledger(spark: SparkSession, root: str, name: str, version: int | None) -> DataFrame:
    """(stream, batch): the last batch per stream that version ``version`` holds."""
    path = f"{root.rstrip('/')}/{name}/ledger/v={version}"
    if version is None or not path_exists(spark, path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def applied_batches(spark: SparkSession, root: str, name: str, version: int | None) -> dict[str, int]:
    """The ledger of a version: one entry per stream."""
    return {r.stream: r.batch for r in read_ledger(spark, root, name, version).collect()}


def write_snapshot(df: DataFrame, root: str, name: str, version: int | None = None, base: int | None = None,
                   applied: dict[str, int] | None = None) -> int:
    """Write ``df`` as the next version (or ``version``) of a table (A7); returns it.

    ``base`` is the version that ``df`` was computed from: if it is no longer
    the newest, the write is refused with ``SnapshotConflict``. A version is
    never replaced; the number of one that a dead writer left incomplete is
    passed over. The ledger is carried over, with ``applied`` on top.
    """
    spark = df.sparkSession
    folder = f"{root.rstrip('/')}/{name}"
    latest = _latest(spark, root, name)
    if base is not None and latest != base:
        raise SnapshotConflict(f"{name}: version {latest} was written since version {base} was read")
    target = version if version is not None else 1 if latest is None else latest + 1
    while path_exists(spark, f"{folder}/v={target}"):
        if version is not None:
            raise SnapshotConflict(f"{name}: version {target} is taken")
        target += 1
    more = spark.createDataFrame(sorted((applied or {}).items()), _LEDGER)
    ledger = (read_ledger(spark, root, name, latest).unionByName(more).groupBy("stream").agg(F.max("batch").alias("batch")))
    if applied or latest is not None and path_exists(spark, f"{folder}/ledger/v={latest}"):
        ledger.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/v={target}")
    df.write.mode("errorifexists").parquet(f"{folder}/v={target}")
    return target


def update_snapshot(spark: SparkSession, root: str, name: str, change: Callable[[DataFrame], DataFrame],
                    stream: tuple[str, int] | None = None) -> int:
    """Read the newest state, pending stream changes included, and write
    ``change`` of it as the next version. With ``stream`` = (query id, batch
    id) a batch that the newest version already holds changes nothing."""
    base = _latest(spark, root, name)
    if base is None:
        raise FileNotFoundError(f"no snapshot of {name} under {root}; write the starting table first")
    held = applied_batches(spark, root, name, base)
    if stream and held.get(stream[0], -1) >= stream[1]:
        return base
    from .pending import clear_pending, pending_batches

    folded = pending_batches(spark, root, name, base)
    version = write_snapshot(change(read_snapshot(spark, root, name)), root, name, base=base,
                             applied={**folded, **(dict([stream]) if stream else {})})
    clear_pending(spark, root, name, base)
    return version


def prune_snapshots(spark: SparkSession, root: str, name: str, keep: int) -> list[int]:
    """Delete all but the newest ``keep`` committed versions; returns the
    versions removed. Readers take the newest version, so they are unaffected."""
    if keep < 1:
        raise ValueError("keep at least one version")
    versions = snapshot_versions(spark, root, name)
    drop = versions[:-keep]
    fs, base = _fs(spark, f"{root.rstrip('/')}/{name}")
    for v in drop:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base, f"v={v}"), True)
    return drop


def read_snapshot(spark: SparkSession, root: str, name: str, schema: StructType | None = None,
                  version: int | None = None) -> DataFrame:
    """The latest state of a snapshot table: its newest version with what
    streams added to it since; empty if there is neither. A given ``version``
    is read as it was written."""
    from .pending import with_pending

    latest = _latest(spark, root, name) if version is None else version
    reader = spark.read.schema(schema) if schema is not None else spark.read
    base = None if latest is None else reader.parquet(f"{root.rstrip('/')}/{name}/v={latest}")
    if version is not None:
        return base
    merged = with_pending(spark, root, name, latest, base)
    if merged is None:
        if schema is None:
            raise FileNotFoundError(f"no snapshot of {name} under {root}")
        return spark.createDataFrame([], schema)
    return merged


def export_name(kind: str, label: str | None = None, category: str | None = None,
                today: _dt.date | None = None) -> str:
    """File name of an exported view.

    ``inventory`` -> ``inventory-<date>.csv``; ``phone``/``server`` ->
    ``<kind>_data_<label>.csv`` (blanks -> '_', case kept); ``workstation``
    -> ``<category>_<label>_data.csv`` in lower case.
    """
    if kind not in EXPORT_NAME_FORMATS:
        raise ValueError(f"unknown export kind {kind!r}")
    lower = kind == "workstation"
    return EXPORT_NAME_FORMATS[kind].format(date=(today or _dt.date.today()).isoformat(),
                                            label=slug(label or "All", lower=lower),
                                            category=(category or "All").lower())


def export_view(df: DataFrame, root: str, kind: str, label: str | None = None, category: str | None = None,
                today: _dt.date | None = None, single_file: bool = False, style: str = "pandas") -> str:
    """Write the current view as CSV under a derived name; returns the path."""
    path = f"{root.rstrip('/')}/{export_name(kind, label, category, today)}"
    write_csv(df, path, style=style, single_file=single_file)
    return path
