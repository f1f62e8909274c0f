"""Positions and records do not depend on how files are cut into splits."""

import csv
import io
import os
import random

import pytest

from stockroom.sources import load_table, read_export, read_table
from stockroom.sources.lines import opens, stays_open
from pyspark.sql import functions as F

from conftest import rows


class _Cut:
    """Split sizes inside the block; the session's own afterwards."""

    KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def __init__(self, spark, size):
        self.spark, self.size = spark, str(size)

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k) for k in self.KEYS}
        self.spark.conf.set(self.KEYS[0], self.size)
        self.spark.conf.set(self.KEYS[1], "16")

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.set(k, v)


def _files(folder, n=3, lines=120):
    for f in range(n):
        with open(os.path.join(folder, f"p{f}.csv"), "w") as out:
            out.write("f,n\n" + "".join(f"{f},{i}\n" for i in range(lines)))
    return [(1 + lines * f + i, f, i) for f in range(n) for i in range(lines)]


def test_positions_hold_when_the_split_size_changes_before_the_action(spark, tmp_dir):
    want = _files(tmp_dir)
    for first, then in ((128, 1 << 20), (1 << 20, 128), (100, 300)):
        with _Cut(spark, first):
            df = read_table(spark, tmp_dir, types={"f": "int", "n": "int"}, position="RowID")
        with _Cut(spark, then):
            assert sorted((r.RowID, r.f, r.n) for r in df.collect()) == want


def test_export_holds_when_the_split_size_changes_before_the_action(spark, tmp_dir):
    for f in range(3):
        with open(os.path.join(tmp_dir, f"e{f}.csv"), "w") as out:
            out.write("".join(f"banner {i},\n" for i in range(20)) + "n,f\n" + "".join(f"{i},{f}\n" for i in range(60)))
    want = sorted((i, f) for f in range(3) for i in range(60))
    for first, then in ((256, 1 << 20), (1 << 20, 256)):
        with _Cut(spark, first):
            df = read_export(spark, tmp_dir, header_record=21, types={"n": "int", "f": "int"}, position="at")
        with _Cut(spark, then):
            got = df.collect()
        assert sorted((r.n, r.f) for r in got) == want
        assert sorted((r.at, r.f, r.n) for r in got) == [(1 + 60 * f + n, f, n) for f in range(3) for n in range(60)]


def test_parquet_positions_hold_for_any_split_size(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    old = spark.conf.get("parquet.block.size", None)
    spark.range(0, 20000, 1, 3).selectExpr("id AS n").write.option("parquet.block.size", 4096).parquet(path)
    schema = spark.read.parquet(path).schema
    with _Cut(spark, 2048):
        df = load_table(spark, tmp_dir, "t", schema, position="pos", start=0)
        assert all(r.n == r.pos for r in df.collect())
    assert df.count() == 20000 and all(r.n == r.pos for r in df.collect())
    assert old == spark.conf.get("parquet.block.size", None)


def _ends_inside(line, inside):
    """The state machine of a quoted CSV line, one character at a time."""
    state = "quoted" if inside else "start"
    k = 0
    while k < len(line):
        c = line[k]
        if state == "quoted":
            if c == '"' and line[k + 1:k + 2] == '"':
                k += 1
            elif c == '"':
                state = "field"
        elif c == ",":
            state = "start"
        elif c == '"' and state == "start":
            state = "quoted"
        else:
            state = "field"
        k += 1
    return state == "quoted"


def test_line_states_against_a_state_machine(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('",a') for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ['"' + "a," * 50000, "a," * 50000 + '"b', '""' * 30000]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", opens(F.col("x")).alias("o"), stays_open(F.col("x")).alias("i"))
    for r in got.collect():
        assert (r.o, r.i) == (_ends_inside(r.x, False), _ends_inside(r.x, True)), r.x[:40]


def _records(seed, n):
    rng = random.Random(seed)
    words = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "", "three\n\nlines", "x" * 30, '24" screen']
    return [[str(i), rng.choice(words), rng.choice(words)] for i in range(n)]


def _as_csv(rows_, header):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([header, *rows_])
    return out.getvalue()


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_records_over_several_lines_and_splits(spark, tmp_dir, size):
    want = []
    for f in range(3):
        data = _records(f, 40)
        with open(os.path.join(tmp_dir, f"r{f}.csv"), "w") as out:
            out.write(_as_csv(data, ["n", "a", "b"]))
        want += [(f * 40 + i + 1, int(n), a or None, b or None) for i, (n, a, b) in enumerate(data)]
    with _Cut(spark, size):
        df = read_table(spark, tmp_dir, types={"n": "int"}, position="at")
    with _Cut(spark, 500):
        got = sorted((r.at, r.n, r.a, r.b) for r in df.collect())
    assert got == want
    assert rows(read_table(spark, tmp_dir, types={"n": "int"}), "n", "a", "b") == sorted(
        [w[1:] for w in want], key=lambda t: tuple((x is None, str(x)) for x in t))


def test_export_with_line_breaks_in_the_preamble_and_the_rows(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.csv"), "w", newline="") as out:
        out.write('"Report\nfor all",\r\n\r\nNumber,Note\r\n1,"first\r\nsecond"\r\n2,plain\r\n')
    df = read_export(spark, tmp_dir, header_record=2, types={"Number": "int"})
    assert rows(df) == [(1, "first\r\nsecond"), (2, "plain")]


def test_a_quote_that_never_closes_is_an_error(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.csv"), "w") as out:
        out.write('n,a\n1,"open\n2,b\n')
    with pytest.raises(Exception, match="not closed"):
        read_table(spark, tmp_dir).collect()
