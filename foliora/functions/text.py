"""Column functions on recognised text. All are native expressions; null gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, unit repairs in order, Arabic unit names in order, and the letters of a strength.
ARABIC_DIGITS, PERSIAN_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
UNIT_REPAIRS = [("(?iu)", "mq", "mg"), ("(?iu)", "mcg", "mcg"), ("", "µg", "mcg"), ("(?iu)", "iu", "IU"), ("(?iu)", "ml", "mL"), ("(?iu)", "l", "L")]
ATTACHED_UNITS = "mg|mL|mcg|IU|g|L|%"
ARABIC_UNITS = [("مجم", "mg"), ("مل", "mL"), ("جم", "g"), ("مكجم", "mcg"), ("وحدة دولية", "IU")]
STRENGTH_UNITS = "mg|ml|mcg|iu|g|l|%|مجم|مل|جم"
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
STRENGTH = rf"(?iu)(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?){WHITE}*({STRENGTH_UNITS})"
ARABIC_LETTERS = r"\x{0600}-\x{06FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
TOKEN = r"[a-zA-Z\x{0600}-\x{06FF}]{4,}"


def normalize_digits(text: Column) -> Column:
    """Arabic-Indic and extended Arabic-Indic digits as ASCII digits."""
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, DIGITS * 2)


def normalize_units(text: Column) -> Column:
    """Misread and misspelt unit names repaired, and a space set between a number and its unit."""
    for flags, wrong, right in UNIT_REPAIRS:
        text = F.regexp_replace(text, rf"{flags}(?<![\p{{L}}\p{{N}}_]){wrong}(?![\p{{L}}\p{{N}}_])", right)
    return F.regexp_replace(text, rf"(\p{{Nd}})({ATTACHED_UNITS})", "$1 $2")


def normalize_numerals(text: Column) -> Column:
    return normalize_units(normalize_digits(text))


def arabic_units(text: Column) -> Column:
    """Arabic unit names replaced one after another, also inside words (so the fourth is never met)."""
    for name, unit in ARABIC_UNITS:
        text = F.replace(text, F.lit(name), F.lit(unit))
    return text


def strict_arabic_units(text: Column) -> Column:
    """Arabic unit names that stand after a number and end there, the longest first; other words stay as they are."""
    for name, unit in sorted(ARABIC_UNITS, key=lambda u: -len(u[0])):
        text = F.regexp_replace(text, rf"(?<=\p{{Nd}})({WHITE}*){name}(?![\p{{L}}\p{{M}}])", f"$1{unit}")
    return text


def clean(text: Column, strict_units: bool = False) -> Column:
    """Digits, units and Arabic unit names; strict_units replaces those only where they are units."""
    return (strict_arabic_units if strict_units else arabic_units)(normalize_numerals(text))


def clean_region(text: Column, script: Column, bidi: bool = False, strict_units: bool = False) -> Column:
    """The cleaned text of a region; with bidi in display order where its script is arabic or mixed (for display only: names and strengths are read from the logical order)."""
    out = clean(text, strict_units)
    if not bidi:
        return out
    from foliora.operators.imaging import display_order

    return F.when(script.isin("arabic", "mixed"), display_order(out)).otherwise(out)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: the variable of a lambda, unlike an expression, is not computed again where it is used in another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_strengths(text: Column) -> Column:
    """ARRAY<STRUCT<value, unit, raw, start, end>>; offsets count characters of the normalised text.

    The text is normalised once and scanned twice, for the matches and for what stands between them; offsets are
    running sums of lengths, so the work is linear in the text.
    """

    def one(raw, end):
        value, unit = (F.regexp_extract(raw, STRENGTH, k) for k in (1, 2))
        return F.struct(F.replace(value, F.lit(","), F.lit(".")).alias("value"), F.lower(unit).alias("unit"), raw.alias("raw"), (end - F.length(raw)).cast("int").alias("start"), end.cast("int").alias("end"))

    def add(ends, step):
        return F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + step))

    def placed(norm, raws):
        steps = F.zip_with(F.slice(F.split(norm, STRENGTH, -1), F.lit(1), F.size(raws)), raws, lambda gap, raw: F.length(gap) + F.length(raw))
        return let(F.aggregate(steps, F.expr("cast(array() as array<int>)"), add), lambda ends: F.zip_with(raws, ends, one))

    return let(normalize_numerals(text), lambda norm: let(F.regexp_extract_all(norm, F.lit(STRENGTH), F.lit(0)), lambda raws: placed(norm, raws)))


def count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def script_of(text: Column) -> Column:
    """arabic, latin, mixed or unknown by the share of letters."""
    a, n = count_of(text, ARABIC_LETTERS), count_of(text, "a-zA-Z")
    ratio = a / F.when(a + n > 0, a + n)
    return F.when(ratio.isNull(), "unknown").when(ratio > 0.7, "arabic").when(ratio < 0.3, "latin").otherwise("mixed")


def has_arabic(text: Column) -> Column:
    return text.rlike(f"[{ARABIC_LETTERS}]")


def script_hint(stem: Column, words: bool = False) -> Column:
    """Script that a file name hints at. By default bare substrings count, as names are; words=True asks for whole parts."""
    s = F.lower(stem)
    if words:
        ar, en = s.rlike(r"(^|[_\-. ])(ar|arabic)([_\-. ]|$)|عربي"), s.rlike(r"(^|[_\-. ])(en|english)([_\-. ]|$)")
    else:
        ar, en = F.contains(s, F.lit("ar")) | F.contains(s, F.lit("عربي")), F.contains(s, F.lit("en"))
    return F.when(ar & en, "mixed").when(ar, "arabic").when(en, "latin").otherwise("mixed")


def confidence_of(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0.0).when(n < 10, 0.4).when(n > 50, 0.92).otherwise(0.75)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def merge_scripts(en: Column, en_conf: Column, ar: Column, ar_conf: Column) -> Column:
    """STRUCT<text, confidence> of the two recognisers' answers for one mixed region."""
    e, a = strip(F.coalesce(en, F.lit(""))), strip(F.coalesce(ar, F.lit("")))
    ec, ac = F.coalesce(en_conf, F.lit(0.0)), F.coalesce(ar_conf, F.lit(0.0))
    arabic_only = (script_of(a) == "arabic") & (script_of(e) != "arabic")

    def of(t, c):
        return F.struct(t.alias("text"), c.alias("confidence"))

    return F.when((e == "") & (a == ""), of(F.lit(""), F.lit(0.0))).when(a == "", of(e, ec)).when((e == "") | arabic_only, of(a, ac)).otherwise(of(F.concat(a, F.lit("\n\n"), e), (ec + ac) / 2))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
