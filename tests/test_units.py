import pytest

from foliora.operators.units import common_amounts, read_number, read_quantity

TARGETS = [("mass", "mg"), ("volume", "ml"), ("activity", "iu"), ("concentration", "mg/ml")]
SCHEMA = "strength_id bigint, lang string, value string, unit string, raw string"


@pytest.mark.parametrize("text,lang,want", [("1,200", "en", 1200), ("1.200", "de", 1200), ("12,5", "fr", 12.5), ("0.125", "es", 0.125), ("1 200", "fr", 1200), ("٠٫٥", "ar", 0.5), ("2.5", "de", 2.5)])
def test_numbers(text, lang, want):
    from foliora.operators.units import tidy

    assert read_number(tidy(text), lang) == want


def test_words_and_over():
    assert read_quantity("two hundred and fifty micrograms", "en")[0] == 250
    assert read_quantity("half a litre", "en")[0] == 0.5
    assert read_quantity("100 mcg / 5 ml", "en") == (100.0, "mcg", 5.0, "ml")
    assert read_quantity(None, "en") == (None,) * 4 and read_quantity("tbd", "en")[0] is None


def test_amounts(spark):
    rows = [
        (1, "en", "500", "mcg", "500 mcg"), (2, "en", "5", "mg", "5 mg"), (3, "en", None, None, "100 mg / 5 ml"), (4, "en", "5", "%", "5%"), (5, "de", None, None, "2,5 g"),
        (6, "en", None, None, None), (7, "en", "7", None, None), (8, None, "", "", ""), (9, "en", "x" * 5000, "mg", "y" * 5000), (1, "en", "500", "mcg", "500 mcg"), (10, "en", "2", "g", "2 mg"),
    ]
    rows += [(100 + k, "en", str(k * 1000), "mg", f"{k} blobs") for k in range(1, 9)]  # a spelling told by its links alone
    df = spark.createDataFrame(rows + [(200 + k, "en", "3", "blobs", None) for k in range(3)], SCHEMA)
    got = {r["strength_id"]: (r["common_unit"], round(r["amount"], 6), r["plain"]) for r in common_amounts(df, spark.createDataFrame(TARGETS, "dimension string, common_unit string")).collect()}
    assert got[1] == ("mg", 0.5, False) and got[2] == ("mg", 5.0, True) and got[3] == ("mg/ml", 20.0, False) and got[5] == ("mg", 2500.0, False) and got[10] == ("mg", 2.0, False)
    assert not {4, 6, 7, 8} & set(got) and got[103] == ("mg", 3000.0, True) and got[200] == ("mg", 3000.0, False)


def test_empty(spark):
    assert common_amounts(spark.createDataFrame([], SCHEMA), spark.createDataFrame(TARGETS, "dimension string, common_unit string")).count() == 0


NONE = "token string, dimension string, power int"


def linked(k, printed, unit, factor, offset=0.0, n=8):
    """n rows printed in one unit and parsed in another."""
    return [(k + x, "en", f"{x * factor + offset:.6f}".rstrip("0").rstrip("."), unit, f"{x} {printed}") for x in range(2, 2 + n)]


def test_conversions_from_links_alone(spark):
    """A chain of six hops, conversions that are no powers of ten, and one with an offset, without any table of names."""
    rows, chain = [], ["mg", "uu", "vv", "ww", "xx", "yy", "zz"]
    for k in range(6):  # one of the next is ten of the one before
        rows += linked(100 * (k + 1), chain[k + 1], chain[k], 10)
    rows += linked(1000, "oz", "mg", 28349.523125) + linked(1100, "qq", "mg", 10, 5) + linked(1200, "noise", "mg", 1, n=2)
    rows += [(1300 + k, "en", str(k * k + 1), "mg", f"{k} odd") for k in range(3, 12)]
    rows += [(9000 + k, "en", None, None, f"3 {u}") for k, u in enumerate([*chain, "oz", "qq", "noise", "odd"])]
    targets = spark.createDataFrame(TARGETS, "dimension string, common_unit string")
    got = {r["strength_id"]: round(r["amount"], 3) for r in common_amounts(spark.createDataFrame(rows, SCHEMA), targets, spark.createDataFrame([], NONE)).collect()}
    assert [got.get(9000 + k) for k in range(7)] == [3.0 * 10**k for k in range(7)]
    assert got[9007] == 85048.569 and got[9008] == 35.0 and 9009 not in got and 9010 not in got


def test_recall_without_names(spark):
    """Where every spelling is linked to the common one often enough, the table of names adds nothing."""
    rows = [r for k, (u, f) in enumerate([("g", 1000), ("gram", 1000), ("mcg", 0.001), ("milligrams", 1), ("kg", 1_000_000)]) for r in linked(100 * (k + 1), u, "mg", f)]
    targets = spark.createDataFrame(TARGETS, "dimension string, common_unit string")
    df = spark.createDataFrame(rows, SCHEMA)
    amounts = lambda d: {r["strength_id"]: round(r["amount"], 6) for r in d.collect()}
    assert amounts(common_amounts(df, targets, spark.createDataFrame([], NONE))) == amounts(common_amounts(df, targets)) and len(amounts(common_amounts(df, targets))) == 40
