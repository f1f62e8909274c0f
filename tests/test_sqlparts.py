"""The DuckDB twins of the column functions agree with Spark on edge cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stockroom.functions import estimate_price, first_number, match_key, parse_money, squish, trim_ws
from stockroom.functions.pricing import DEFAULT_PRICE_RULES
from stockroom.plans import sqlparts as S

TEXTS = ["  a \t b ", "\ta\n", "", None, " USB ", "$1,234.56", "12", "N/A", "5d", "NaN", " -3.5 ", "1e3",
         "GS20 FE 5G", "S20+ 5G", "iPhone 13 mini", "iPhone 13 Pro", "S21", "Galaxy S20 Plus", "XR", "x14",
         "Jetpack MiFi 8800L", "iPhone XR", "model 12b 7"]

CASES = [
    ("trim_ws", trim_ws, S.trim_ws),
    ("squish", squish, S.squish),
    ("match_key", match_key, S.key),
    ("parse_money", parse_money, S.parse_money),
    ("price", lambda c: estimate_price(c).cast("double"), lambda x: S.price_rules(x, DEFAULT_PRICE_RULES)),
    ("first_number", first_number, S.first_number),
]


@pytest.mark.parametrize("label,spark_fn,sql_fn", CASES, ids=[c[0] for c in CASES])
def test_sql_twin_agrees(spark, label, spark_fn, sql_fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", spark_fn(F.col("t")).alias("r")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(TEXTS)))
    want = dict(con.execute(f"SELECT i, {sql_fn('t')} FROM x").fetchall())
    assert got == want
