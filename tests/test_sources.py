"""Sources and sinks: CSV exports, snapshots, GeoJSON, divider layouts."""

import datetime as dt
import json
import os

import pytest

from pyspark.sql.types import LongType, StringType, StructField, StructType

from stockroom.sources import (SnapshotConflict, export_name, export_view, flatten_sections, load_table, prune_snapshots,
                               read_export, read_feature_names, read_snapshot, read_table, snapshot_versions,
                               write_csv, write_snapshot)

from conftest import rows


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_table_pandas_and_readr_styles(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "inv.csv"),
               'Item,Quantity,Comments,Section\n'
               'Lenovo AMD4 Chromebook ,1,Keyboard not working,Laptops\n'
               'HDMI "4K" cable,2,,Cables\n'
               '"Cable, ""long""",NA,"Not working, old",Cables\n')
    pdf = read_table(spark, p, types={"Quantity": "bigint"})
    assert rows(pdf) == [('Cable, "long"', None, "Not working, old", "Cables"),
                         ('HDMI "4K" cable', 2, None, "Cables"),
                         ("Lenovo AMD4 Chromebook ", 1, "Keyboard not working", "Laptops")]
    rdf = read_table(spark, p, types={"Quantity": "bigint"}, style="readr")
    assert ("Lenovo AMD4 Chromebook", 1, "Keyboard not working", "Laptops") in rows(rdf)


def test_read_table_keeps_long_ids_as_text(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "ids.csv"), "Device ID,n\n350000000000012,1\n")
    df = read_table(spark, p, types={"Device ID": "double", "n": "int"}, string_cols=["Device ID"])
    assert df.first()["Device ID"] == "350000000000012"


def test_read_export_header_record(spark, tmp_dir):
    # Five preamble records, a blank line, the header in record 6, then data
    # with a quoted comma.
    p = _write(os.path.join(tmp_dir, "plans.csv"),
               "Account report,,\nPeriod,May,\n\n,,\nCompany,X,\nTotals,,\n"
               "Number / User Name,Cost Center,Total Charges\n"
               '803-555-0100  A. User,HH ADMIN,"$1,234.56"\n'
               "803-555-0101  B. User,Food,$10.00\n")
    df = read_export(spark, p, header_record=6)
    assert df.columns == ["Number / User Name", "Cost Center", "Total Charges"]
    assert rows(df) == [("803-555-0100  A. User", "HH ADMIN", "$1,234.56"),
                        ("803-555-0101  B. User", "Food", "$10.00")]


def test_read_export_each_file_by_its_own_header(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "a.csv"), "Report,\nNumber,Charge\n1,$5.00\n\n2,N/A\n")
    _write(os.path.join(tmp_dir, "b.csv"), "\n\nReport,\nCharge,Number,Note\n$7.00,3,\"x, y\"\n")
    df = read_export(spark, tmp_dir, header_record=2, types={"Number": "int"})
    assert df.columns == ["Number", "Charge", "Note"]
    assert rows(df) == [(1, "$5.00", None), (2, None, None), (3, "$7.00", "x, y")]


def test_read_export_preamble_longer_than_a_split(spark, tmp_dir):
    body = "".join(f"{i},{i * i}\n" for i in range(200))
    _write(os.path.join(tmp_dir, "long.csv"), "".join(f"banner {i},\n" for i in range(40)) + "n,square\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        df = read_export(spark, tmp_dir, header_record=41, types={"n": "int", "square": "int"})
        assert sorted(map(tuple, df.collect())) == [(i, i * i) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_positions_are_the_line_order_over_files_and_splits(spark, tmp_dir):
    for f in range(3):
        _write(os.path.join(tmp_dir, f"p{f}.csv"), "f,n\n" + "".join(f"{f},{i}\n" for i in range(100)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        df = read_table(spark, tmp_dir, types={"f": "int", "n": "int"}, position="RowID")
        assert df.rdd.getNumPartitions() > 3
        assert sorted((r.RowID, r.f, r.n) for r in df.collect()) == [
            (1 + 100 * f + n, f, n) for f in range(3) for n in range(100)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    table = spark.createDataFrame([(i,) for i in range(50)], "n int").coalesce(1)
    write_snapshot(table, tmp_dir, "t")
    back = load_table(spark, tmp_dir, "t", table.schema, position="pos", start=0)
    assert all(r.n == r.pos for r in back.collect()) and back.count() == 50
    assert load_table(spark, tmp_dir, "none", table.schema, position="pos").columns == ["n", "pos"]


def test_read_export_short_file_is_an_error(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "a.csv"), "Report,\nNumber,Charge\n1,2\n")
    _write(os.path.join(tmp_dir, "b.csv"), "Report,\n")
    with pytest.raises(ValueError, match="1 of 2 files"):
        read_export(spark, tmp_dir, header_record=2)


def test_write_csv_round_trip_and_null_styles(spark, tmp_dir):
    df = spark.createDataFrame([("a", None, "x,y"), ("b", 2, "")], "k string, v long, t string")
    out = os.path.join(tmp_dir, "out")
    write_csv(df, out)
    back = read_table(spark, out, types={"v": "bigint"})
    assert rows(back) == [("a", None, "x,y"), ("b", 2, None)]
    out2 = os.path.join(tmp_dir, "out_r")
    write_csv(df, out2, style="readr", single_file=True)
    text = "".join(open(os.path.join(out2, f)).read() for f in os.listdir(out2) if f.endswith(".csv"))
    assert "a,NA," in text


def test_load_table_missing_is_empty(spark, tmp_dir):
    schema = StructType([StructField("Item", StringType()), StructField("Quantity", LongType())])
    df = load_table(spark, tmp_dir, "absent", schema)
    assert df.count() == 0 and df.schema == schema


def test_snapshots_versions_and_replay(spark, tmp_dir):
    a = spark.createDataFrame([("x", 1)], "Item string, Quantity long")
    b = spark.createDataFrame([("x", 2)], "Item string, Quantity long")
    assert write_snapshot(a, tmp_dir, "inv") == 1
    assert write_snapshot(b, tmp_dir, "inv") == 2
    with pytest.raises(SnapshotConflict):
        write_snapshot(a, tmp_dir, "inv", version=2)
    with pytest.raises(SnapshotConflict):
        write_snapshot(a, tmp_dir, "inv", base=1)
    assert snapshot_versions(spark, tmp_dir, "inv") == [1, 2]
    assert rows(read_snapshot(spark, tmp_dir, "inv")) == [("x", 2)]
    assert rows(read_snapshot(spark, tmp_dir, "inv", version=1)) == [("x", 1)]


def test_export_names_and_view(spark, tmp_dir):
    assert export_name("inventory", today=dt.date(2024, 5, 1)) == "inventory-2024-05-01.csv"
    assert export_name("phone", "Columbia SC") == "phone_data_Columbia_SC.csv"
    assert export_name("server", "All") == "server_data_All.csv"
    assert export_name("workstation", "Dept F", category="Department") == "department_dept_f_data.csv"
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    path = export_view(df, tmp_dir, "phone", "Columbia SC")
    assert path.endswith("phone_data_Columbia_SC.csv") and os.path.isdir(path)


def test_read_feature_names(spark, tmp_dir):
    geo = {"type": "FeatureCollection",
           "features": [{"type": "Feature", "properties": {"name": n}, "geometry": None}
                        for n in ["Aiken", "Richland", "Charleston"]]}
    p = _write(os.path.join(tmp_dir, "counties.geojson"), json.dumps(geo, indent=1))
    assert rows(read_feature_names(spark, p)) == [("Aiken",), ("Charleston",), ("Richland",)]


def test_flatten_sections(spark):
    sheet = [("Laptops", None, 1), ("Dell 5540", 2, 2), ("Dell 3420", 2, 3), ("Laptop Chargers", None, 4),
             ("Lenovo 65W", 2, 5), ("Tablets", None, 6), ("Galaxy Tab", 4, 7)]
    df = spark.createDataFrame(sheet, "Item string, Quantity long, pos long")
    for parts in (1, 2, 5):
        out = flatten_sections(df, "pos", num_partitions=parts)
        assert rows(out, "Item", "Section") == [("Dell 3420", "Laptops"), ("Dell 5540", "Laptops"),
                                                ("Galaxy Tab", "Tablets"), ("Lenovo 65W", "Laptop Chargers")]


def test_flatten_sections_per_file(spark):
    df = spark.createDataFrame([("a.csv", "S1", None, 1), ("a.csv", "x", 1, 2), ("b.csv", "y", 1, 1),
                                ("b.csv", "S2", None, 2), ("b.csv", "z", 1, 3)],
                               "file string, Item string, Quantity long, pos long")
    out = flatten_sections(df, "pos", group_cols=["file"], num_partitions=3)
    assert rows(out, "file", "Item", "Section") == [("a.csv", "x", "S1"), ("b.csv", "y", None), ("b.csv", "z", "S2")]


def test_read_export_many_files_and_splits(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "exports")
    os.makedirs(folder)
    expected = []
    for f in range(3):
        lines = ["Report for account,,", "", f"Generated,{f},", "Name,Cost Center,Total"]
        for i in range(200):
            lines.append(f"u{f}-{i},C{i % 3},\"${i},000.00\"")
            expected.append((f"u{f}-{i}", f"C{i % 3}", f"${i},000.00"))
            if i % 50 == 0:
                lines.append("")
        _write(os.path.join(folder, f"part{f}.csv"), "\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        df = read_export(spark, folder, header_record=3)
        assert df.columns == ["Name", "Cost Center", "Total"]
        assert spark.read.text(folder).rdd.getNumPartitions() > 6
        assert rows(df) == sorted(expected, key=lambda t: tuple((x is None, str(x)) for x in t))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_prune_snapshots_keeps_newest(spark, tmp_dir):
    for q in (1, 2, 3, 4):
        write_snapshot(spark.createDataFrame([("x", q)], "Item string, Quantity long"), tmp_dir, "inv")
    assert prune_snapshots(spark, tmp_dir, "inv", keep=2) == [1, 2]
    assert snapshot_versions(spark, tmp_dir, "inv") == [3, 4]
    assert rows(read_snapshot(spark, tmp_dir, "inv")) == [("x", 4)]


def test_read_table_quoted_line_breaks(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "notes.csv"), 'Item,Comments\nDock,"two\nlines"\nPen,\n')
    df = read_table(spark, p, multiline=True)
    assert rows(df) == [("Dock", "two\nlines"), ("Pen", None)]


def test_load_table_takes_the_newest_version(spark, tmp_dir):
    schema = StructType([StructField("Item", StringType()), StructField("Quantity", LongType())])
    for q in (1, 2, 3):
        write_snapshot(spark.createDataFrame([("x", q)], schema), tmp_dir, "inv")
    df = load_table(spark, tmp_dir, "inv", schema)
    assert df.columns == ["Item", "Quantity"] and rows(df) == [("x", 3)]


def test_csv_keeps_outer_blanks(spark, tmp_dir):
    out = os.path.join(tmp_dir, "blanks")
    write_csv(spark.createDataFrame([(" a b ", "x")], "k string, v string"), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert " a b ,x" in text
