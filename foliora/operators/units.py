"""Quantities recorded in different units, brought to one common unit for each kind.

Every printed quantity is read twice: as printed (``raw``) and as an earlier parser took it (``value``
and ``unit``). The two readings of one row are a link between two unit spellings, each spelling being a
source with its own scale. Over all links of a pair of spellings the operator estimates a robust scale
(the modal ratio after snapping to known conversions) or, where no ratio holds, a resistant line (scale from
the medians of the outer thirds, offset the median residual), builds a graph of spellings from the pairs that
agree, and propagates scale and offset from the common units through it until nothing more is reached. Only
spellings that the graph does not reach take the scale of their usual name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.session import cut_lineage
from foliora.sources.tables import once

# Known conversions, as powers of ten to the common unit, by usual name.
KNOWN_UNITS = {
    ("mass", 0): "mg mgs mgm milligram milligrams milligramme milligrammes miligramo miligramos مجم ملجم ملغ ملغم مليجرام ميليغرام میلی‌گرم",
    ("mass", 3): "g gm gms gr gram grams gramme grammes gramm gramo gramos جم غ غم جرام غرام گرم",
    ("mass", 6): "kg kilogram kilograms",
    ("mass", -3): "mcg ug µg microgram micrograms microgramme microgrammes mikrogramm microgramo microgramos مكجم مكغ ميكروجرام میکروگرم",
    ("mass", -6): "ng nanogram nanograms nanogramme nanogrammes nanogramm nanogramo nanogramos نانوجرام نانوگرم",
    ("volume", 0): "ml cc c.c. milliliter milliliters millilitre millilitres mililitro mililitros مل مليلتر میلی‌لیتر",
    ("volume", 3): "l lt liter liters litre litres litro litros لتر ليتر لیتر",
    ("volume", 2): "dl deciliter deciliters decilitre decilitres décilitre décilitres deziliter decilitro decilitros ديسيلتر دسی‌لیتر",
    ("volume", 1): "cl centiliter centiliters centilitre centilitres zentiliter centilitro centilitros سنتيلتر سانتی‌لیتر",
    ("volume", -3): "ul µl microliter microlitre microlitres mikroliter microlitro microlitros ميكرولتر میکرولیتر",
    ("activity", 0): "iu i.u. ui u.i. ie i.e. و.د.",
    ("activity", 3): "kiu",
    ("activity", 6): "miu",
}
# Names of the unit of activity in several words, and the words for thousand and million before it.
ACTIVITY_NAMES = ["international units", "international unit", "int. units", "units (iu)", "unités internationales", "internationale einheiten", "unidades internacionales", "وحدة دولية", "وحده دوليه", "واحد بین‌المللی"]
MULTIPLES = {3: ["thousand", "k", "tsd.", "tausend", "mille", "milliers d'", "mil", "x10^3", "ألف", "هزار"], 6: ["million", "m", "mio", "mio.", "millionen", "millions d'", "million d'", "millones de", "millón de", "x10^6", "مليون", "میلیون"]}
# Numbers written as words in the languages of the leaflets.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "half": 0.5,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "quinze": 15, "vingt": 20,
    "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "cent": 100, "cents": 100, "demi": 0.5,
    "ein": 1, "eine": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "fünfzehn": 15,
    "zwanzig": 20, "dreißig": 30, "vierzig": 40, "fünfzig": 50, "hundert": 100, "zweihundert": 200, "zweihundertfünfzig": 250, "fünfhundert": 500, "halb": 0.5, "halber": 0.5,
    "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "quince": 15,
    "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "cien": 100, "ciento": 100, "doscientos": 200, "quinientos": 500, "medio": 0.5, "media": 0.5,
    "اثنان": 2, "ثلاثة": 3, "أربعة": 4, "خمسة": 5, "ستة": 6, "سبعة": 7, "ثمانية": 8, "تسعة": 9, "عشرة": 10, "عشرون": 20, "عشرين": 20,
    "خمسون": 50, "خمسين": 50, "مئة": 100, "مائة": 100, "مئتان": 200, "خمسمئة": 500, "خمسمائة": 500, "نصف": 0.5,
    "یک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج": 5, "شش": 6, "هفت": 7, "هشت": 8, "نه": 9, "ده": 10, "بیست": 20, "پنجاه": 50, "صد": 100, "دویست": 200, "پانصد": 500, "نیم": 0.5,
}
NUMBER_GLUE = {"and", "a", "et", "und", "y", "و", "of"}
PER = r"(?:/|\bper\b|\bpro\b|\bpar\b|\bpor\b|\bje\b|لكل)"
DECIMAL_COMMA = {"fr", "de", "es"}
SPACES = dict.fromkeys(map(ord, "    "), " ")
NUMBER = re.compile(r"[0-9]+(?: [0-9]{3}(?![0-9]))*(?:[.,'٫٬][0-9]+)*")
# Known conversions that are no powers of ten (inch, foot, ounce, pound, grain, fluid ounce, pint, gallon, teaspoon, tablespoon, degree Fahrenheit, week, day, hour and minute).
OTHER_FACTORS = [25.4, 30.48, 28.349523125, 453.59237, 64.79891, 29.5735295625, 473.176473, 3.785411784, 4.92892159375, 14.78676478125, 5 / 9, 7.0, 24.0, 60.0]
#: Snapping tolerance of log10 of a ratio for powers of ten and for the others, least links of a spelling, least share of its links that agree, tolerance of a line's residuals.
SNAP, FINE, MIN_LINKS, MIN_SHARE, RESIDUAL = 0.02, 0.002, 3, 0.5, 1e-3

READING = T.StructType(
    [
        T.StructField("number", T.DoubleType()),
        T.StructField("phrase", T.StringType()),
        T.StructField("per_number", T.DoubleType()),
        T.StructField("per_phrase", T.StringType()),
    ]
)


def tidy(text: str) -> str:
    """Lower case, plain spaces, ASCII digits, one micro sign; marks of direction removed."""
    out = []
    for c in text.translate(SPACES):
        if unicodedata.decimal(c, None) is not None:
            out.append(str(unicodedata.decimal(c)))
        elif c == "μ":
            out.append("µ")
        elif c not in "‎‏‪‫‬﻿":
            out.append(c)
    return re.sub(r"\s+", " ", "".join(out)).strip().lower()


def read_number(text: str, lang: str | None) -> float | None:
    """A printed number in the language's usual form: decimal comma in fr, de and es, else decimal point."""
    s = text.replace(" ", "").replace("'", "")
    if "٫" in s or "٬" in s:
        s = s.replace("٬", "").replace(",", "").replace("٫", ".")
    else:
        mark, group = (",", ".") if (lang or "")[:2].lower() in DECIMAL_COMMA else (".", ",")
        if group in s:
            grouped = re.fullmatch(rf"[1-9][0-9]{{0,2}}(?:\{group}[0-9]{{3}})+(?:\{mark}[0-9]+)?", s)
            s = s.replace(group, "") if grouped or s.count(group) > 1 or mark in s else s.replace(group, mark)
        s = s.replace(mark, ".") if mark == "," else s
    try:
        return float(s)
    except ValueError:
        return None


def _words(s: str) -> tuple[float, int, int] | None:
    """The first run of number words: its value, start and end."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\s/():]+", s)]
    for i, (w, start, _) in enumerate(words):
        if w not in NUMBER_WORDS:
            continue
        total, j = 0.0, i
        while j < len(words) and (words[j][0] in NUMBER_WORDS or (words[j][0] in NUMBER_GLUE and j + 1 < len(words) and (words[j + 1][0] in NUMBER_WORDS or words[j - 1][0] in ("half", "medio", "demi")))):
            n = NUMBER_WORDS.get(words[j][0], 0)
            total = total * 100 if n == 100 and 0 < total < 100 else total + n
            j += 1
        return total, start, words[j - 1][2]
    return None


@lru_cache(maxsize=100_000)
def read_quantity(text: str | None, lang: str | None) -> tuple:
    """(number, what follows it, number and words after a stroke or "per"); None where there is none."""
    if text is None:
        return None, None, None, None
    s = tidy(text)
    m = NUMBER.search(s)
    if m:
        number, rest = read_number(m[0], lang), s[m.end() :]
    elif w := _words(s):
        number, rest = w[0], s[w[2] :]
    else:
        return None, None, None, None
    over = re.split(PER, rest, maxsplit=1)
    phrase, per = over[0].strip(" -"), over[1].strip() if len(over) > 1 else None
    per_number = None
    if per:
        if d := NUMBER.match(per):
            per_number, per = read_number(d[0], lang), per[d.end() :].strip()
        elif (d := _words(per)) and d[1] == 0:
            per_number, per = d[0], per[d[2] :].strip()
    return number, phrase or None, per_number, per


@F.pandas_udf(READING)
def reading(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
    rows = [read_quantity(t, g) for t, g in zip(text, lang)]
    return pd.DataFrame(rows, columns=READING.names)


@F.pandas_udf(T.StringType())
def tidy_unit(unit: pd.Series) -> pd.Series:
    seen: dict = {}
    return unit.map(lambda u: seen.setdefault(u, (tidy(u) or None) if u is not None else None))


def _prefixes(phrase: Column, most: int) -> Column:
    """Runs of words (at most as many as the longest spelling has) from the start of the phrase, with their lengths."""
    words = F.slice(F.split(phrase, " "), 1, most)
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, 1, n), " ").alias("token")))


def known_units(spark) -> DataFrame:
    named = [(n, kind, p) for (kind, p), names in KNOWN_UNITS.items() for n in names.split()]
    activity = KNOWN_UNITS["activity", 0].split() + ACTIVITY_NAMES
    named += [(n, "activity", 0) for n in ACTIVITY_NAMES]
    named += [(word + (" " if word[-1] != "'" else "") + n, "activity", p) for p, many in MULTIPLES.items() for word in many for n in activity]
    rows = [(n.replace("‌", z), kind, p) for n, kind, p in named for z in ("‌", " ")]
    return spark.createDataFrame(sorted(set(rows)), "token string, dimension string, power int")


def snapped(ratio: Column) -> Column:
    """The known conversion nearest to a ratio: a power of ten, or another one up or down in decimal steps; null where none is near."""
    log = F.log10(ratio)
    other = F.array(*[F.struct(F.lit(math.log10(f)).alias("log"), F.lit(f).alias("factor")) for k in OTHER_FACTORS for f in (k, 1 / k)])
    near = F.get(F.filter(other, lambda o: F.abs((log - o["log"]) - F.round(log - o["log"])) < FINE), F.lit(0))
    return F.when(F.abs(log - F.round(log)) < SNAP, F.pow(F.lit(10.0), F.round(log))).otherwise(near["factor"] * F.pow(F.lit(10.0), F.round(log - near["log"])))


def link_scales(pairs: DataFrame) -> DataFrame:
    """Robust scale and offset of each pair of spellings (a, b) from linked readings: columns a, b, x, y, w (links) with y = factor * x + offset; n of its links agree.

    The ratio of every link is snapped to a known conversion; the pair's scale is the modal one if at least
    MIN_SHARE of the links agree, else that of a resistant line, if it is a known conversion too and as many lie
    on the line. Links that fit nothing count against the pair. Nulls give no link.
    """
    links = pairs.filter("x is not null and y is not null and a is not null and b is not null").groupBy("a", "b", "x", "y").agg(F.sum("w").alias("w"))
    ratios = links.withColumn("factor", F.when((F.col("x") > 0) & (F.col("y") > 0), snapped(F.col("y") / F.col("x"))))
    votes = ratios.groupBy("a", "b", "factor").agg(F.sum("w").alias("n"), F.count_distinct("x").alias("kinds"))
    modal = votes.groupBy("a", "b").agg(F.sum("n").alias("links"), F.sum("kinds").alias("kinds"), F.max_by(F.struct("factor", "n"), F.struct(F.when(F.col("factor").isNotNull(), F.col("n")).otherwise(0), -F.abs(F.log10("factor")))).alias("m"))
    modal = cut_lineage(modal.select("a", "b", F.col("m.factor").alias("factor"), F.when(F.col("m.factor").isNotNull(), F.col("m.n")).otherwise(0).alias("n"), "links", "kinds"))
    sure = F.coalesce(F.col("n") >= MIN_SHARE * F.col("links"), F.lit(False))
    by_ratio = modal.filter(sure).select("a", "b", "factor", F.lit(0.0).alias("offset"), "n", "links")
    # the rest may differ by an offset; a line needs several distinct values
    open_ = modal.filter(~sure & (F.col("links") >= MIN_LINKS) & (F.col("kinds") >= 6)).select("a", "b", "links")
    own = links.join(open_, ["a", "b"])
    thirds = own.groupBy("a", "b").agg(F.percentile_approx("x", [1 / 3, 2 / 3]).alias("q"))
    mid = lambda c, low: F.percentile_approx(F.when(F.col("x") <= F.col("q")[0] if low else F.col("x") >= F.col("q")[1], F.col(c)), 0.5)
    lines = own.join(thirds, ["a", "b"]).groupBy("a", "b").agg(mid("x", True).alias("x0"), mid("x", False).alias("x1"), mid("y", True).alias("y0"), mid("y", False).alias("y1"))
    lines = lines.filter("x1 > x0 and y1 > y0").withColumn("factor", snapped((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))).filter("factor is not null").select("a", "b", "factor")
    rest = own.join(lines, ["a", "b"]).withColumn("r", F.col("y") - F.col("factor") * F.col("x"))
    offsets = rest.groupBy("a", "b").agg(F.percentile_approx("r", 0.5, 10_000).alias("offset"))
    on = F.abs(F.col("r") - F.col("offset")) <= RESIDUAL * F.greatest(F.abs(F.col("y")), F.abs(F.col("offset")))
    by_line = rest.join(offsets, ["a", "b"]).groupBy("a", "b", "factor", "offset", "links").agg(F.sum(F.when(on, F.col("w")).otherwise(0)).alias("n")).filter(F.col("n") >= MIN_SHARE * F.col("links"))
    return by_ratio.unionByName(by_line.select("a", "b", "factor", "offset", "n", "links")).unionByName(modal.filter(~sure).join(by_line, ["a", "b"], "left_anti").select("a", "b", F.lit(None).cast("double").alias("factor"), F.lit(0.0).alias("offset"), F.lit(0).cast("bigint").alias("n"), "links"))


def propagate(edges: DataFrame, anchors: DataFrame, names: DataFrame) -> DataFrame:
    """(token, dimension, factor, offset) of every spelling that the graph joins to a common unit: amount = factor * number + offset.

    anchors: the common units. names: known conversions of usual names. Each round gives a spelling the conversion
    with most agreeing links to spellings already placed; it is placed if that is at least MIN_LINKS links and
    MIN_SHARE of its links to them (links of a spelling with itself, or with one not yet placed, tell nothing).
    Rounds go on until none is placed; then every spelling is judged once more by all its neighbours. Spellings left
    over take their known name. Ties go to the smaller dimension and factor.
    """
    told = edges.filter("a != b").select("a", "b", "factor", "offset", "n", "links")
    back = told.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 / F.col("factor")).alias("factor"), (-F.col("offset") / F.col("factor")).alias("offset"), "n", "links")
    both = cut_lineage(told.unionByName(back))
    placed = cut_lineage(anchors.dropDuplicates(["token"]).withColumn("offset", F.lit(0.0)).select("token", "dimension", "factor", "offset"))

    def votes(of: DataFrame, by: DataFrame) -> DataFrame:
        return (
            of.join(by.select(F.col("token").alias("b"), "dimension", F.col("factor").alias("f"), F.col("offset").alias("o")), "b")
            .withColumn("whole", F.col("f") * F.col("factor"))
            .withColumn("shift", F.col("f") * F.col("offset") + F.col("o"))
            .groupBy("a", "dimension", F.round(F.log10("whole"), 4).alias("log"), F.round("shift", 6).alias("shift"))
            .agg(F.sum("n").alias("n"), F.min("whole").alias("whole"), F.sum("links").alias("links"))
            .groupBy("a")
            .agg(F.max_by(F.struct("dimension", "log", "whole", "shift", "n"), F.struct(F.when(F.col("log").isNotNull(), F.col("n")).otherwise(0), F.col("dimension"), -F.col("log"))).alias("m"), F.sum("links").alias("total"))
            .filter((F.col("m.n") >= MIN_LINKS) & (F.col("m.n") >= MIN_SHARE * F.col("total")) & F.col("m.log").isNotNull())
            .select(F.col("a").alias("token"), "m.dimension", F.when(F.abs(F.col("m.log") - F.round("m.log")) < 1e-3, F.pow(F.lit(10.0), F.round("m.log"))).otherwise(F.col("m.whole")).alias("factor"), F.col("m.shift").alias("offset"))
        )

    known = first = placed.count()
    while True:
        placed = cut_lineage(placed.unionByName(votes(both.join(placed.select(F.col("token").alias("a")), "a", "left_anti"), placed)))
        n = placed.count()
        if n == known:
            break
        known = n
    if known > first:
        start = anchors.select("token")
        again = votes(both.join(start.withColumnRenamed("token", "a"), "a", "left_anti"), placed)
        kept = placed.join(again.select("token"), "token", "left_anti")
        placed = cut_lineage(kept.unionByName(again.select(*kept.columns)))
    usual = names.select("token", "dimension", F.pow(F.lit(10.0), F.col("power")).alias("factor"), F.lit(0.0).alias("offset"))
    return placed.unionByName(usual.join(placed.select("token"), "token", "left_anti"))


def common_amounts(strengths: DataFrame, targets: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row for each strength whose amount and unit can be told: strength_id, dimension, common_unit, amount, plain.

    strengths needs strength_id, lang, value, unit, raw; other columns are ignored. targets: dimension,
    common_unit; names: token, dimension, power, the usual names that serve where links are too few (known_units
    by default). ``plain`` says that the row is already in common form. Nulls in any column, empty and
    very long texts, zero amounts and unknown units give no row or are read from what is left; repeated
    rows give equal rows (the result is distinct); empty tables give an empty result.
    """
    spark = strengths.sparkSession
    keyed = strengths.select("strength_id", "lang", "value", "unit", "raw").filter("strength_id is not null")

    def parsed(df: DataFrame) -> DataFrame:
        df = df.withColumn("r", reading("raw", "lang")).withColumn("v", reading("value", "lang")).withColumn("u", tidy_unit("unit"))
        return df.withColumn("rp", F.col("r.phrase")).withColumn("vp", F.coalesce(F.col("v.phrase"), F.col("u")))

    # the scales are fitted on the distinct readings with their counts: far fewer than rows
    fit = cut_lineage(parsed(once(keyed, "strength_id").groupBy("lang", "value", "unit", "raw").agg(F.count("*").alias("rows"))))

    anchors = targets.select(F.lower("common_unit").alias("token"), "dimension").withColumn("factor", F.lit(1.0))
    names = known_units(spark) if names is None else names
    phrases = cut_lineage(fit.select(F.explode(F.array("rp", "vp", "r.per_phrase", "v.per_phrase")).alias("phrase"), "rows").filter("phrase is not null").groupBy("phrase").agg(F.sum("rows").alias("n")))
    # spellings: what the parser took for a unit, usual names, and whole phrases no longer than those
    parser = fit.groupBy(F.col("u").alias("token")).agg(F.sum("rows").alias("n")).filter("token is not null and n >= 2").select("token")
    listed = parser.unionByName(names.select("token")).unionByName(anchors.select("token"))
    most = listed.agg(F.max(F.size(F.split("token", " ")))).first()[0] or 1
    whole = phrases.filter((F.col("n") >= MIN_LINKS) & (F.size(F.split("phrase", " ")) <= most)).select(F.col("phrase").alias("token"))
    vocabulary = cut_lineage(listed.unionByName(whole).distinct())
    prefixes = cut_lineage(phrases.select("phrase", F.explode(_prefixes(F.col("phrase"), most)).alias("c")).select("phrase", "c.n", "c.token").join(vocabulary, "token"))

    linked = fit.filter(F.col("rp").isNotNull() & F.col("u").isNotNull() & F.col("r.per_phrase").isNull()).join(prefixes.select(F.col("phrase").alias("rp"), "token"), "rp")
    edges = cut_lineage(link_scales(linked.select(F.col("token").alias("a"), F.col("u").alias("b"), F.col("r.number").alias("x"), F.col("v.number").alias("y"), F.col("rows").alias("w"))))
    scales = propagate(edges, anchors, names)
    # a phrase takes the longest of its beginnings that has a scale
    scaled = cut_lineage(prefixes.join(scales, "token").groupBy("phrase").agg(F.max_by(F.struct("dimension", "factor", "offset"), "n").alias("s")).select("phrase", "s.*"))
    rows = parsed(keyed)

    def with_scale(df: DataFrame, phrase: str, as_: str) -> DataFrame:
        return df.join(scaled.select(F.col("phrase").alias(phrase), F.struct("dimension", "factor", "offset").alias(as_)), phrase, "left")

    flat = rows.select("strength_id", "value", "unit", "rp", "vp", F.col("r.number").alias("rn"), F.col("v.number").alias("vn"), F.col("r.per_number").alias("rdn"), F.col("v.per_number").alias("vdn"), F.col("r.per_phrase").alias("rdp"), F.col("v.per_phrase").alias("vdp"), "u")
    flat = with_scale(with_scale(with_scale(with_scale(flat, "rp", "rs"), "vp", "vs"), "rdp", "rds"), "vdp", "vds")
    from_raw = F.col("rp").isNotNull() & F.col("rn").isNotNull()
    # a printed number without unit takes the parser's unit; the parser's number counts where none is printed
    n = F.when(from_raw, F.col("rn")).otherwise(F.coalesce("rn", "vn"))
    s = F.when(from_raw, F.col("rs")).otherwise(F.col("vs"))
    dp = F.when(from_raw, F.col("rdp")).otherwise(F.col("vdp"))
    d = F.when(from_raw, F.col("rds")).otherwise(F.col("vds"))
    dn = F.coalesce(F.when(from_raw, F.col("rdn")).otherwise(F.col("vdn")), F.lit(1.0))
    over_volume = dp.isNotNull() & (d["dimension"] == "volume")
    out = flat.select("strength_id", "value", "unit", n.alias("n"), s.alias("s"), d.alias("d"), dn.alias("dn"), over_volume.alias("over"))
    kind = F.when(F.coalesce("over", F.lit(False)), F.when(F.col("s.dimension") == "mass", F.lit("concentration"))).otherwise(F.col("s.dimension"))
    amount = (F.col("n") * F.col("s.factor") + F.col("s.offset")) / F.when(F.coalesce("over", F.lit(False)), F.col("dn") * F.col("d.factor")).otherwise(F.lit(1.0))
    out = out.select("strength_id", "value", "unit", kind.alias("dimension"), amount.alias("amount")).filter("dimension is not null and amount is not null").join(targets.select("dimension", "common_unit").dropDuplicates(["dimension"]), "dimension")
    plain = (F.col("unit") == F.col("common_unit")) & F.col("value").rlike(r"^[0-9]+(\.[0-9]+)?$") & (F.abs(F.expr("try_cast(value as double)") - F.col("amount")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("amount")))
    return out.select("strength_id", "dimension", "common_unit", "amount", F.coalesce(plain, F.lit(False)).alias("plain"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    from foliora.sources.tables import table

    got = common_amounts(table(spark, sf_dir, "strengths"), table(spark, sf_dir, "unit_targets"))
    return got.filter("not plain").select("strength_id", "common_unit", F.round(F.col("amount") * 1e6).cast("bigint").alias("micro_amount")).distinct()
