"""Many keyword rules as a join: same prices as the rules one by one."""

import random
import re

from stockroom.operators import price_by_rule_table, rules_frame


def test_ten_thousand_rules_equal_the_rules_one_by_one(spark):
    rng = random.Random(7)
    words = [f"W{k}" for k in range(60)] + ["GS", "5G", "Ä1"]
    rules = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), float(k)) for k in range(9_999)]
    rules.insert(5_000, ("W1-W2", -1.0))
    texts = sorted({"".join(rng.choice(words) + rng.choice([" ", " ", "-", "  "]) for _ in range(rng.randint(0, 6))) for _ in range(200)})
    want = {}
    compiled = [(re.compile(rf"(?<!\w){re.escape(k)}(?!\w)"), p) for k, p in dict.fromkeys(rules)]
    for t in texts:
        want[t] = next((p for k, p in compiled if k.search(t)), 300.0)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "m string")
    got = price_by_rule_table(df, "m", rules_frame(spark, rules), "p", clean=False, default=300.0)
    assert {r.m: r.p for r in got.collect()} == {**want, None: 300.0}


def test_an_empty_keyword_matches_texts_with_a_word(spark):
    df = spark.createDataFrame([("a b",), ("--",), ("",), (None,)], "m string")
    got = price_by_rule_table(df, "m", [("B", 1.0), ("", 2.0)], "p", clean=False, default=9.0)
    assert {r.m: r.p for r in got.collect()} == {"a b": 1.0, "--": 9.0, "": 9.0, None: 9.0}
    got = price_by_rule_table(df, "m", [("", 2.0), ("B", 1.0)], "p", clean=False, default=9.0)
    assert {r.m: r.p for r in got.collect()}["a b"] == 2.0
