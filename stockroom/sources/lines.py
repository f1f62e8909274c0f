"""Lines and records of text files that stay in place however files are cut.

A scan of text files knows where its own split began, but two scans may cut
the same files differently (another split size, more executors). Lines are
therefore written once, with (file, block, number), and every later pass
reads that copy.

A CSV record can go on over several lines where a quoted field holds line
breaks. Whether a line begins inside such a field depends on all lines above
it in the file, yet no task reads a file alone: what a line does to that
state is one of four functions (stay, end outside, end inside, swap), which
compose. They are composed within a split by a window, and the splits' own
functions (one row per split) are composed over the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_once

PLACE = ["_file", "_block", "_m"]

# A field that ends on its line: quoted ("" is a quote inside it, and what
# follows the closing quote is taken as it stands), plain, or empty.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|)'
_TO_OPEN = rf'(?:{_FIELD},)*+"{_QUOTED}\z'  # whole fields, then one that does not end
_OPENS = rf"\A{_TO_OPEN}"
_STAYS = rf'\A{_QUOTED}(?:\z|"[^,]*+,{_TO_OPEN})'


def _has_quote(line: Column) -> Column:
    return line.contains('"')


def opens(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted field."""
    return _has_quote(line) & line.rlike(_OPENS)


def stays_open(line: Column) -> Column:
    """Whether a line that begins inside a quoted field ends inside one."""
    return ~_has_quote(line) | line.rlike(_STAYS)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "_line")


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any line of the files leaves a quoted field open: only then
    does a record hold a line break. One pass, one row back."""
    return bool(_scan(spark, path).agg(F.bool_or(opens(F.col("_line")))).first()[0])


def placed(scan: DataFrame, label: str) -> DataFrame:
    """A file scan written once with each row's file, block and number. The
    number grows along a block; nothing is shuffled or sorted."""
    return write_once(scan.select("*", F.col("_metadata.file_path").alias("_file"),
                                  F.col("_metadata.file_block_start").alias("_block"),
                                  F.monotonically_increasing_id().alias("_m")), label)


def placed_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _m, _line): the CSV records of text files, each at the
    place of its first line and without its line end. A quoted field that a
    file does not close is an error."""
    lines = placed(_scan(spark, path), "lines")
    if lines.agg(F.bool_or(opens(F.col("_line")))).first()[0]:
        lines = write_once(join_records(lines), "records")
    return lines.withColumn("_line", F.regexp_replace("_line", r"\r\z", ""))


def _after(value: Column, parity: Column, start: Column) -> Column:
    """State after a run of lines that entered with ``start``: ``value`` where
    a line fixed it, else swapped ``parity`` times."""
    return F.coalesce(value, (start + parity) % 2)


def join_records(lines: DataFrame) -> DataFrame:
    """Lines as records: those of one record become one row at the place of
    its first line. Files whose lines all close their quotes pass untouched;
    of the others only flags are shuffled, by split, and the text of records
    that do span lines."""
    line = F.col("_line")
    flags = lines.select(*PLACE, opens(line).alias("_o"), stays_open(line).alias("_i"))
    flags = flags.join(flags.where("_o").select("_file").distinct(), "_file", "left_semi")
    split = Window.partitionBy("_file", "_block").orderBy("_m")
    upto = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixes = F.when(F.col("_o") == F.col("_i"), F.col("_o").cast("int"))
    swaps = flags.withColumn("_s", F.sum((F.col("_o") & ~F.col("_i")).cast("int")).over(upto))
    fixed = swaps.withColumn("_f", F.last(F.when(fixes.isNotNull(), F.struct(fixes.alias("v"), F.col("_s").alias("s"))), True).over(upto))
    # State after each line: fixed within its split, or the split's own state swapped.
    known = fixed.select(*PLACE, F.col("_s").alias("_parity"), ((F.col("_f.v") + F.col("_s") - F.col("_f.s")) % 2).alias("_value"))
    known = write_once(known, "quote-states")

    file = Window.partitionBy("_file").orderBy("_block")
    whole = known.groupBy("_file", "_block").agg(F.max_by(F.struct("_value", "_parity"), "_m").alias("_w"))
    run = whole.select("_file", "_block", F.col("_w._value").alias("_v"),
                       F.sum(F.col("_w._parity") % 2).over(file.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_p"))
    run = run.withColumn("_f", F.last(F.when(F.col("_v").isNotNull(), F.struct("_v", "_p")), True).over(
        file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.coalesce(F.col("_f._v") + F.col("_p") - F.col("_f._p"), F.col("_p")) % 2
    begins = run.select("_file", "_block", F.lag(end, 1, 0).over(file).alias("_begin"),
                        (end == 1).alias("_open_end"), F.row_number().over(Window.partitionBy("_file").orderBy(F.desc("_block"))).alias("_back"))

    state = known.join(begins, ["_file", "_block"])
    after = _after(F.col("_value"), F.col("_parity"), F.col("_begin"))
    state = state.withColumn("_after", after)
    state = state.withColumn("_before", F.lag("_after", 1).over(split))
    state = state.withColumn("_before", F.coalesce("_before", "_begin"))
    # First line of each line's record: in its split, or the last one of an earlier split.
    own = F.last(F.when(F.col("_before") == 0, F.struct("_block", "_m")), True).over(upto)
    state = state.withColumn("_first", own)
    last = state.groupBy("_file", "_block").agg(F.max(F.when(F.col("_before") == 0, F.struct("_block", "_m"))).alias("_last"))
    earlier = last.select("_file", "_block", F.last("_last", True).over(file.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    spread = (state.where((F.col("_before") == 1) | (F.col("_after") == 1)).join(earlier, ["_file", "_block"])
              .select(*PLACE, F.coalesce("_first", "_earlier").alias("_first"),
                      (F.col("_open_end") & (F.col("_back") == 1) & (F.col("_after") == 1)).alias("_unclosed")))
    spread = write_once(spread, "record-lines")

    parts = spread.join(lines, PLACE).groupBy("_file", "_first").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_m", "_line"))).alias("_parts"),
        F.max(F.struct("_block", "_m", "_unclosed"))["_unclosed"].alias("_unclosed"))
    text = F.array_join(F.transform("_parts", lambda p: p["_line"]), "\n")
    closed = F.when(F.col("_unclosed"), F.raise_error(F.concat(F.lit("a quoted field is not closed in "), F.col("_file")))
                    .cast("string")).otherwise(text)
    joined = parts.select("_file", F.col("_first._block").alias("_block"), F.col("_first._m").alias("_m"), closed.alias("_line"))
    return lines.select(*PLACE, "_line").join(spread.select(*PLACE), PLACE, "left_anti").unionByName(joined)
