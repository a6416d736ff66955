import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliora.functions import text as X

# input, after numerals, clean, strengths of clean (value, unit, raw, start, end)
GOLDEN = [
    ("500 mq", "500 mg", "500 mg", [("500", "mg", "500 mg", 0, 6)]),
    ("500mq", "500mq", "500mq", []),
    ("500 MG", "500 MG", "500 MG", [("500", "mg", "500 MG", 0, 6)]),
    ("500mg", "500 mg", "500 mg", [("500", "mg", "500 mg", 0, 6)]),
    ("500 ML", "500 mL", "500 mL", [("500", "ml", "500 mL", 0, 6)]),
    ("5 µg", "5 mcg", "5 mcg", [("5", "mcg", "5 mcg", 0, 5)]),
    ("5µg", "5µg", "5µg", []),
    ("100iu", "100iu", "100iu", [("100", "iu", "100iu", 0, 5)]),
    ("l'eau", "L'eau", "L'eau", []),
    ("5Lactose", "5 Lactose", "5 Lactose", [("5", "l", "5 L", 0, 3)]),
    ("5%", "5 %", "5 %", [("5", "%", "5 %", 0, 3)]),
    ("٥٠٠ مجم", "500 مجم", "500 mg", [("500", "mg", "500 mg", 0, 6)]),
    ("۲۵مل", "25مل", "25mL", [("25", "ml", "25 mL", 0, 5)]),
    ("٥ مكجم", "5 مكجم", "5 مكg", []),
    ("شامل", "شامل", "شاmL", []),
    ("1,000 mg", "1,000 mg", "1,000 mg", [("1.000", "mg", "1,000 mg", 0, 8)]),
    ("1.234,5 mg", "1.234,5 mg", "1.234,5 mg", [("234.5", "mg", "234,5 mg", 2, 10)]),
    ("0.5 MCG", "0.5 mcg", "0.5 mcg", [("0.5", "mcg", "0.5 mcg", 0, 7)]),
]


def test_golden(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "t string")
    c = X.clean(F.col("t"))
    rows = df.select("t", X.normalize_numerals(F.col("t")).alias("n"), c.alias("c"), X.extract_strengths(c).alias("s")).collect()
    for r, (t, n, clean, strengths) in zip(rows, GOLDEN):
        assert (r["n"], r["c"], [tuple(s) for s in r["s"]]) == (n, clean, strengths), t


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    rows = df.select(X.clean(F.col("t")).alias("c"), X.script_of(F.col("t")).alias("s"), X.confidence_of(F.col("t")).alias("k")).collect()
    assert rows[0]["c"] is None and rows[1]["c"] == "" and rows[1]["s"] == "unknown" and rows[1]["k"] == 0.0


@pytest.mark.parametrize("n,want", [(0, 0.0), (9, 0.4), (10, 0.75), (50, 0.75), (51, 0.92)])
def test_confidence(spark, n, want):
    assert spark.range(1).select(X.confidence_of(F.lit("x" * n)).alias("c")).first()["c"] == want


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="0123456789٠١٢mgLµl%. ,مجلx", max_size=30))
def test_offsets_point_at_raw(spark, t):
    r = spark.createDataFrame([(t,)], "t string").select(X.normalize_numerals(F.col("t")).alias("n"), X.extract_strengths(F.col("t")).alias("s")).first()
    assert not re.search("[٠-٩]", r["n"])
    for s in r["s"]:
        assert r["n"][s["start"] : s["end"]] == s["raw"]


def test_script_hint(spark):
    df = spark.createDataFrame([("paracetamol",), ("ibuprofen",), ("paracetamol_en",), ("x",)], "t string")
    assert [r[0] for r in df.select(X.script_hint(F.col("t"))).collect()] == ["arabic", "latin", "mixed", "mixed"]


def test_offsets_of_many_strengths(spark):
    """Offsets index the normalised text, also far into it."""
    text = "take 500 mq of it, ٢٥ mg or 5%; " * 300
    r = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.extract_strengths(F.col("t")).alias("s"), X.normalize_numerals(F.col("t")).alias("n")).collect()
    assert len(r[0]["s"]) == 900 and all(r[0]["n"][s["start"] : s["end"]] == s["raw"] for s in r[0]["s"]) and r[1]["s"] is None and r[2]["s"] == []
    strict = spark.createDataFrame([("10 شامل 5 مكجم 7 مل.",)], "t string").select(X.clean(F.col("t"), strict_units=True).alias("c")).first()["c"]
    assert strict == "10 شامل 5 mcg 7 mL."
