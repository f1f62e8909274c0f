"""Table sources."""

from __future__ import annotations

import csv
import logging
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import write_once
from .lines import PLACE, has_line_breaks, placed, placed_records
from .sinks import _fs, read_snapshot, snapshot_versions

log = logging.getLogger("stockroom")

# Text that pandas.read_csv reads as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Text that readr::read_csv reads as missing by default.
READR_NA_TOKENS = ("", "NA")

_BLANK_LINE = r"^\s*$"


def _string_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def _numbered_splits(rows: DataFrame, name: str, start: int) -> DataFrame:
    """Rows with (_file, _block, _m), ``_m`` without gaps in a split, as rows
    with their dense place over files in order of their paths. Only counts (one row
    per split) are put in order. ``rows`` is a written copy, so both passes
    see the same splits; a split without its count is an error."""
    splits = rows.groupBy("_file", "_block").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                                - F.col("_m0") + start).alias("_off"))
    place = F.coalesce("_off", F.raise_error(F.lit("a split has no position")).cast("long")) + F.col("_m")
    return rows.join(offsets, ["_file", "_block"], "left").withColumn(name, place).drop("_off", *PLACE)


def _parquet_position(scan: DataFrame, name: str, start: int) -> DataFrame:
    """Parquet rows know their place in their file, however it is cut; files
    in order of their paths. One count per file is put in order."""
    rows = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_off"))
    place = F.coalesce("_off", F.raise_error(F.lit("a file has no position")).cast("long")) + F.col("_at")
    return rows.join(offsets, "_file", "left").withColumn(name, place).drop("_off", "_file", "_at")


def _null_tokens(df: DataFrame, tokens: Iterable[str], columns: Sequence[str] | None = None) -> DataFrame:
    tokens = [t for t in tokens if t != ""]
    if not tokens:
        return df
    columns = df.columns if columns is None else columns
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(tokens), F.lit(None)).otherwise(F.col(f"`{c}`"))
                           for c in columns})


def _cast(df: DataFrame, types: Mapping[str, str] | None) -> DataFrame:
    if not types:
        return df
    return df.select(*[(F.col(f"`{c}`").try_cast(types[c]) if c in types else F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


def read_table(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
               style: str = "pandas", string_cols: Sequence[str] = (), multiline: bool | None = None,
               position: str | None = None, start: int = 1) -> DataFrame:
    """CSV with a header row (A1, A2).

    Every column is read as text (no inference pass over the data), missing
    tokens become null, then ``types`` are applied with ``try_cast`` except
    for ``string_cols``, which stay text (long ids, phone numbers).
    ``style='readr'`` also trims fields and reads only ''/NA as missing.
    Line breaks inside quoted fields are found by one pass over the text
    (``multiline`` states beforehand whether there are any); records with
    them are put together across splits, files are never read by one task.
    ``position`` names a column for the place of each row in the source (W1):
    files in order of their paths, rows in file order, from ``start`` on. It
    does not depend on how files are cut into splits, now or later.
    """
    readr = style == "readr"
    if has_line_breaks(spark, path) if multiline is None else multiline:
        df = _parsed_records(spark, path, 1, position, start, trim=readr)
    else:
        reader = (spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
                  .option("ignoreLeadingWhiteSpace", readr).option("ignoreTrailingWhiteSpace", readr))
        df = reader.csv(path)
        if position:
            df = _numbered_splits(placed(df, "positions"), position, start)
    columns = [c for c in df.columns if c != position]
    df = _null_tokens(df, READR_NA_TOKENS if readr else PANDAS_NA_TOKENS, columns)
    types = {k: v for k, v in (types or {}).items() if k not in set(string_cols)}
    return _cast(df, types)


def _export_headers(records: DataFrame, header_record: int) -> DataFrame:
    """Per file: its ``header_record``-th non-blank record (``_header``) and
    that record's place (``_hblock``, ``_hm``). The rank is limited before the
    shuffle, so each scan task sends at most that many records per file."""
    first = Window.partitionBy("_file").orderBy("_block", "_m")
    return (records.where(~F.col("_line").rlike(_BLANK_LINE))
            .withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= header_record)
            .where(F.col("_rank") == header_record)
            .select("_file", F.col("_line").alias("_header"), F.col("_block").alias("_hblock"),
                    F.col("_m").alias("_hm")))


def _header_names(line: str, trim: bool = False) -> list[str]:
    fields = [h.strip(" ") if trim else h for h in next(csv.reader([line], skipinitialspace=trim))]
    names = [h if h else f"_c{i}" for i, h in enumerate(fields)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns named twice in an export header: {twice}")
    return names


def _parsed_records(spark: SparkSession, path: str, header_record: int, position: str | None = None, start: int = 1,
                    trim: bool = False) -> DataFrame:
    """Text columns of the records below each file's header, put together by
    name. The records are a written copy: headers and rows come from one cut."""
    records = placed_records(spark, path)
    heads = write_once(_export_headers(records, header_record), "export-headers")
    found, expected = heads.count(), len(spark.read.text(path).inputFiles())
    if found < expected:
        raise ValueError(f"{expected - found} of {expected} files have fewer than {header_record} non-blank records")

    layouts = [r[0] for r in heads.groupBy("_header").agg(F.min("_file").alias("f")).orderBy("f")
               .select("_header").collect()]
    by_line = {line: _header_names(line, trim) for line in layouts}
    names = list(dict.fromkeys(n for line in layouts for n in by_line[line]))
    width = max((len(h) for h in by_line.values()), default=0)
    # Where each output column stands in the files of a layout (1-based, 0: nowhere).
    places = spark.createDataFrame([(line, [h.index(n) + 1 if n in h else 0 for n in names])
                                    for line, h in by_line.items()], "_header string, _at array<int>")
    ddl = ", ".join(f"_f{i} STRING" for i in range(width))
    below = (F.col("_block") > F.col("_hblock")) | ((F.col("_block") == F.col("_hblock")) & (F.col("_m") > F.col("_hm")))
    body = records.where(~F.col("_line").rlike(_BLANK_LINE)).join(heads.join(places, "_header"), "_file").where(below)
    kept = []
    if position:
        # Blank lines and records of several lines leave gaps: rows are counted anew within their split.
        body = body.withColumn("_m", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_m")))
        body = _numbered_splits(write_once(body.select(*PLACE, "_at", "_line"), "export-rows"), "_place", start)
        kept = ["_place"]
    space = "true" if trim else "false"
    options = {"escape": '"', "ignoreLeadingWhiteSpace": space, "ignoreTrailingWhiteSpace": space, "multiLine": "true"}
    parsed = body.select(*kept, "_at", F.from_csv(F.col("_line"), ddl, options).alias("_r"))
    fields = parsed.select(*kept, "_at", F.array(*[F.col(f"_r._f{i}") for i in range(width)]).alias("_v"))
    return fields.select(*[F.when(F.col("_at")[i] > 0, F.element_at("_v", F.greatest(F.col("_at")[i], F.lit(1)))).alias(n)
                           for i, n in enumerate(names)], *[F.col(c).alias(position) for c in kept])


def read_export(spark: SparkSession, path: str, header_record: int,
                types: Mapping[str, str] | None = None, position: str | None = None, start: int = 1) -> DataFrame:
    """CSV exports whose real header is non-blank record ``header_record``
    (1-based); the records before it are a preamble and are dropped (A3).

    Each file is read by its own header, wherever its preamble ends: the
    columns of all files are put together by name, and a column that a file
    lacks is null there. Lines are written once, put together to records where
    quoted fields hold line breaks, and all further passes read that copy.
    The driver sees one row per *different* header only. Blank lines between
    records are skipped. A file without that many records is an error.
    ``position`` as in ``read_table``.
    """
    df = _parsed_records(spark, path, header_record, position, start)
    columns = [c for c in df.columns if c != position]
    return _cast(_null_tokens(df, PANDAS_NA_TOKENS, columns), types)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table."""
    return spark.read.parquet(path)


def load_table(spark: SparkSession, root: str, name: str, schema: StructType, position: str | None = None,
               start: int = 1) -> DataFrame:
    """Named table (Parquet) with the columns of ``schema``: the latest state
    of a snapshot table, else the folder itself. Only a missing path is an
    empty table plus a warning (A4). ``position`` as in ``read_table``, in the
    newest written version."""
    path = f"{root.rstrip('/')}/{name}"
    fs, base = _fs(spark, path)
    if not fs.exists(base):
        log.warning("table %s not loaded: no such path", path)
        return spark.createDataFrame([], StructType([*schema.fields, StructField(position, LongType())]) if position else schema)
    versions = snapshot_versions(spark, root, name)
    df = spark.read.schema(schema).parquet(f"{path}/v={versions[-1]}" if versions else path)
    names = schema.fieldNames()
    if versions and not position:
        return read_snapshot(spark, root, name, schema).select(names)
    return _parquet_position(df, position, start).select(*names, position) if position else df.select(names)


# The part of a GeoJSON FeatureCollection that is read (no inference pass).
_FEATURES_SCHEMA = "features array<struct<properties: struct<name: string>>>"


def read_feature_names(spark: SparkSession, path: str, name: str = "County") -> DataFrame:
    """``features[].properties.name`` of a GeoJSON file as a one-column
    domain table (A5)."""
    raw = spark.read.schema(_FEATURES_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(F.col("f.properties.name").alias(name))


def from_rows(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """Literal rows -> table (A9); used for fixtures."""
    return spark.createDataFrame(list(rows), schema)
