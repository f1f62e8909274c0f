"""Column functions on literal rows: the edge cases of FIXTURES.md section 3."""

import pytest
from pyspark.sql import functions as F

from stockroom.functions import (clean_model, combine_sections, estimate_price, fill_default, first_number,
                                 flag_contains, format_money, map_or_self, map_values, match_key, parse_event,
                                 parse_money, price_by_rules, slug, slug_col, split_phone, squish, trim_ws,
                                 dashes_to_dots)
from stockroom.functions.categories import DEFAULT_SECTION_GROUPS


def one(spark, values, expr_fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    out = df.select("i", expr_fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_estimate_price_rule_order(spark):
    got = one(spark, ["GS20 FE 5G", "S20+ 5G", "iPhone 13 mini", "iPhone 13 Pro", "S21", None], estimate_price)
    assert got == [300, 350, 650, 700, 0, 0]


def test_price_rules_whole_words_and_order(spark):
    got = one(spark, ["Galaxy S20 Plus", "s21 fe", "Jetpack MiFi 8800L", "iphone 14", "iPhone 140", "XCover Pro"],
              price_by_rules)
    assert got == [450, 400, 100, 800, 0, 350]


def test_clean_model_case_sensitive(spark):
    assert one(spark, ["  Galaxy GS20 ", "gs20"], clean_model) == ["Galaxy S20", "gs20"]


def test_parse_money(spark):
    got = one(spark, ["$1,234.56", "12", "", "N/A", "5d", "NaN", None, " -3.5 "], parse_money)
    assert got == [1234.56, 12.0, None, None, None, None, None, -3.5]


def test_format_money(spark):
    assert one(spark, [1234.5, -5.0, None], format_money, "double") == ["$1,234.50", "$-5.00", None]


def test_split_phone_and_dots(spark):
    values = ["803-555-0100  A. User", "803-555-0100", "A. User", None]
    nums = one(spark, values, lambda c: dashes_to_dots(split_phone(c)[0]))
    names = one(spark, values, lambda c: split_phone(c)[1])
    assert nums == ["803.555.0100", "803.555.0100", None, None]
    assert names == ["A. User", "", None, None]


def test_flag_contains(spark):
    assert one(spark, ["HH Admin", "Food", None], lambda c: flag_contains(c, "ADMIN")) == ["Y", "N", "N"]


def test_map_values_unmapped_is_null(spark):
    assert one(spark, ["Y", "N", "", None], map_values) == ["Yes", "No", None, None]


def test_squish_and_trim(spark):
    assert one(spark, ["  a \t b ", "\ta\n"], squish) == ["a b", "a"]
    assert one(spark, ["  a \t b ", None], trim_ws) == ["a \t b", None]


def test_match_key(spark):
    got = one(spark, [None, "", " USB ", "usb"], match_key)
    assert got == ["", "", "usb", "usb"]


def test_first_number(spark):
    assert one(spark, ["iPhone 13", "iPhone XR", None], first_number) == [13.0, 100.0, 100.0]


def test_map_or_self(spark):
    assert one(spark, ["Columbia", "Charleston", None], map_or_self) == ["Richland", "Charleston", None]


def test_parse_event(spark):
    ids = one(spark, ["plus_12", "minus_3", "other", "plus_x"], lambda c: parse_event(c)[0])
    deltas = one(spark, ["plus_12", "minus_3", "other", "plus_x"], lambda c: parse_event(c)[1])
    assert ids == [12, 3, None, None]
    assert deltas == [1, -1, None, None]


def test_combine_sections_default_mapping(spark):
    sections = [s for _, members in DEFAULT_SECTION_GROUPS for s in members]
    assert len(sections) == 20
    got = one(spark, sections + ["Something Else", None], combine_sections)
    expected = [name for name, members in DEFAULT_SECTION_GROUPS for _ in members] + ["Something Else", None]
    assert got == expected
    assert len(set(got[:20])) == 10


def test_fill_default(spark):
    assert one(spark, [1.5, None], lambda c: fill_default(c, 0.0), "double") == [1.5, 0.0]


@pytest.mark.parametrize("text,lower,expected", [("Columbia SC", False, "Columbia_SC"), ("All", True, "all")])
def test_slug(text, lower, expected):
    assert slug(text, lower) == expected


def test_slug_col(spark):
    assert one(spark, ["Dept F A"], lambda c: slug_col(c, lower=True)) == ["dept_f_a"]
