"""Freely typed names mapped to the entries of a reference list.

Token-level repair: every distinct token (and run of adjacent pieces, for names broken by a space, hyphen
or stop) is joined to the vocabulary of the list by edit distance. The join is exact: a vocabulary token
cut into k + 1 segments keeps one of them unchanged under k edits, so equality on segments finds all
candidates, and Levenshtein distance decides. Names in Arabic script are compared with the letter-by-letter
transcription of the vocabulary; cut-off names with its unique prefixes. The repaired tokens of an input are
then weighed against complete entries by soft TF-IDF.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.session import cut_lineage
from foliora.sources.tables import table

# Usual letter-by-letter transcription of Latin names in Arabic script.
LATIN_TO_ARABIC = {
    "a": "ا", "b": "ب", "c": "ك", "d": "د", "e": "ي", "f": "ف", "g": "ج", "h": "ه", "i": "ي", "j": "ج", "k": "ك", "l": "ل", "m": "م", "n": "ن", "o": "و",
    "p": "ب", "q": "ك", "r": "ر", "s": "س", "t": "ت", "u": "و", "v": "ف", "w": "و", "x": "كس", "y": "ي", "z": "ز",
}
# Letters of one sound in Arabic and Persian spelling, and signs misread for letters.
SAME_ARABIC = str.maketrans("پگکیڤچژأإآىةؤئ", "بجكيفجزاااي" + "هوي")
MISREAD = str.maketrans("0156893|!$@", "oisbbgelisa")
LETTERS = re.compile(r"[^\W\d_]", re.U)
#: Least length of a token for each number of edits, least length of a cut-off name, least score of a match.
EDITS = ((10, 3), (6, 2), (4, 1))
LEAST_PREFIX, LEAST_SCORE = 5, 0.75

#: Distinct inputs that a task splits into runs.
INPUTS_A_TASK = 50_000

PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("cut", T.BooleanType())]))
CHOSEN = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("sim", T.DoubleType())]))


def fold(text: str) -> str:
    """Lower case, compatibility forms, no marks; one form for letters of one sound in Arabic script."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold().translate(SAME_ARABIC))
    return "".join(c for c in s.translate(SAME_ARABIC) if unicodedata.category(c) not in ("Mn", "Cf"))


def transcribe(token: str) -> str:
    return "".join(LATIN_TO_ARABIC.get(c, c) for c in token)


def runs(text: str | None, shortest: int = 4, longest: int = 40) -> list[tuple[int, int, str, bool]]:
    """(first piece, end, letters, cut off) of every run of pieces of one text that a vocabulary with forms of shortest to longest letters can hold."""
    if not text:
        return []
    pieces: list[tuple[str, bool]] = []
    for m in re.finditer(r"[\w|!$@]+", fold(text)):
        w = m[0]
        if len(LETTERS.findall(w)) >= max(1, len(w) / 2):
            pieces.append((w.translate(MISREAD), False))
    closing = text.rstrip()[-1:] in (".", "-", "…")
    out = []
    for i in range(len(pieces)):
        token = ""
        for j in range(i + 1, len(pieces) + 1):
            token += pieces[j - 1][0]
            if len(token) > longest + EDITS[0][1]:
                break
            if len(token) >= shortest:
                out.append((i, j, token, closing and j == len(pieces)))
    return out


def split_runs(text, shortest: int, longest: int):
    @F.pandas_udf(PIECES)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: runs(t, shortest, longest))

    return split(text)


def edits(length) -> int:
    return next((k for least, k in EDITS if length >= least), 0)


@F.pandas_udf(CHOSEN)
def choose(found: pd.Series) -> pd.Series:
    """Of overlapping runs the best: by similarity, then by more pieces, then by place and spelling."""

    def one(rows):
        taken: set[int] = set()
        best = {}
        for r in sorted(rows, key=lambda r: (-round(r["sim"], 6), r["start"] - r["end"], r["start"], r["vocab"])):
            span = set(range(r["start"], r["end"]))
            if not span & taken:
                taken |= span
                best.setdefault(r["vocab"], r["sim"])
        return sorted(best.items())

    return found.map(one)


def vocabulary(entries: DataFrame) -> DataFrame:
    """form, vocab, idf: the tokens of the list as written and in Arabic transcription."""
    n = entries.count()
    tokens = entries.select("pos", F.explode(F.array_distinct(F.filter(F.split(F.lower("inn"), r"[^\p{L}\p{N}]+"), lambda t: t != ""))).alias("vocab"))
    idf = tokens.groupBy("vocab").agg(F.log(F.lit(1.0 + n) / F.count_distinct("pos")).alias("idf"))
    arabic = F.col("vocab")
    for a, b in LATIN_TO_ARABIC.items():
        arabic = F.replace(arabic, F.lit(a), F.lit(b))
    return idf.withColumn("form", F.explode(F.array_distinct(F.array(F.col("vocab"), arabic))))


def _segments(form, length: int, k: int):
    cuts = [round(i * length / (k + 1)) for i in range(k + 2)]
    return [(i, cuts[i], cuts[i + 1] - cuts[i]) for i in range(k + 1)]


def segment_keys(form: str) -> list[str]:
    """Keys of a vocabulary form: number and text of each of its k + 1 segments, and its length."""
    n = len(form)
    return [f"{n}:{i}:{form[a : a + m]}" for i, a, m in _segments(form, n, edits(n))]


def probe_keys(token: str) -> list[str]:
    """Keys under which a vocabulary form within k edits of the token must lie."""
    keys = set()
    for n in range(max(1, len(token) - EDITS[0][1]), len(token) + EDITS[0][1] + 1):
        k = edits(n)
        if abs(n - len(token)) > k:
            continue
        for i, a, m in _segments("", n, k):
            for s in range(max(0, a - k), min(len(token) - m, a + k) + 1):
                keys.add(f"{n}:{i}:{token[s : s + m]}")
    return sorted(keys)


KEYS = T.ArrayType(T.StringType())


@F.pandas_udf(KEYS)
def segment_keys_of(form: pd.Series) -> pd.Series:
    return form.map(segment_keys)


@F.pandas_udf(KEYS)
def probe_keys_of(token: pd.Series) -> pd.Series:
    return token.map(probe_keys)


def repair(tokens: DataFrame, vocab: DataFrame, parts: int) -> DataFrame:
    """token, vocab, sim: vocabulary tokens within the permitted edits of each distinct token, or that it begins; keys are made in ``parts`` tasks."""
    keyed = vocab.withColumn("key", F.explode(segment_keys_of("form")))
    pairs = tokens.select("token").distinct().repartition(parts).withColumn("key", F.explode(probe_keys_of("token"))).join(keyed, "key").select("token", "form", "vocab").distinct()
    k = F.expr(f"case when length(form) >= {EDITS[0][0]} then {EDITS[0][1]} when length(form) >= {EDITS[1][0]} then {EDITS[1][1]} when length(form) >= {EDITS[2][0]} then {EDITS[2][1]} else 0 end")
    d = F.levenshtein("token", "form")
    near = pairs.withColumn("d", d).filter(F.col("d") <= k).select("token", "vocab", (1 - F.col("d") / F.greatest(F.length("token"), F.length("form"))).alias("sim"))
    heads = vocab.withColumn("n", F.explode(F.expr(f"sequence({LEAST_PREFIX}, greatest({LEAST_PREFIX}, length(form) - 1))"))).filter("n < length(form)").select(F.expr("substring(form, 1, n)").alias("token"), "vocab", F.col("n").alias("n"), F.length("form").alias("m"))
    heads = heads.groupBy("token").agg(F.count_distinct("vocab").alias("of"), F.first("vocab").alias("vocab"), F.first(F.col("n") / F.col("m")).alias("share")).filter("of = 1")
    cut = tokens.filter((F.length("token") >= 6) | F.col("cut")).select("token").distinct().join(heads, "token").select("token", "vocab", (0.75 + 0.2 * F.col("share")).alias("sim"))
    return near.unionByName(cut).groupBy("token", "vocab").agg(F.max("sim").alias("sim"))


def match_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """input, pos, inn, score: for every distinct non-blank input its entry, or pos -1 with score 0.

    names needs a column input; entries pos and inn; other columns are ignored. Null and blank inputs
    give no row; very long inputs are read whole; of entries with equal score the first in the list
    counts; an empty list maps every input to -1; repeated inputs give one row.
    """
    inputs = names.select("input").filter(F.length(F.trim("input")) > 0).distinct()
    listed = entries.select("pos", "inn").filter("pos is not null and inn is not null").dropDuplicates(["pos"])
    vocab = cut_lineage(vocabulary(listed))
    sizes = vocab.agg(F.min(F.length("form")).alias("least"), F.max(F.length("form")).alias("most")).first()
    least = sizes["least"] or 1
    inputs = cut_lineage(inputs)
    # spread by rows, not bytes: the work is in the letters of few and short rows
    parts = max(names.sparkSession.sparkContext.defaultParallelism, inputs.count() // INPUTS_A_TASK)
    found = cut_lineage(inputs.repartition(parts).withColumn("r", F.explode(split_runs("input", max(1, min(LEAST_PREFIX, least - edits(least))), sizes["most"] or 0))).select("input", "r.*"))
    fixed = repair(found.select("token", "cut"), vocab, parts)
    per_input = found.join(fixed, "token").groupBy("input").agg(F.collect_list(F.struct("start", "end", "vocab", "sim")).alias("found")).select("input", F.explode(choose("found")).alias("t")).select("input", F.col("t.token").alias("vocab"), F.col("t.sim").alias("sim"))
    weights = vocab.select("vocab", "idf").distinct()
    entry_tokens = listed.select("pos", "inn", F.explode(F.array_distinct(F.filter(F.split(F.lower("inn"), r"[^\p{L}\p{N}]+"), lambda t: t != ""))).alias("vocab")).join(weights, "vocab")
    norms = entry_tokens.groupBy("pos", "inn").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("entry_norm"))
    typed = per_input.join(weights, "vocab")
    typed_norm = typed.groupBy("input").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("input_norm"))
    dots = typed.join(entry_tokens.select("pos", "vocab"), "vocab").groupBy("input", "pos").agg(F.sum(F.col("sim") * F.col("idf") * F.col("idf")).alias("dot"))
    ranked = dots.join(norms, "pos").join(typed_norm, "input").withColumn("score", F.col("dot") / F.col("entry_norm") / F.col("input_norm"))
    best = ranked.groupBy("input").agg(F.max_by(F.struct("pos", "inn", "score"), F.struct(F.round("score", 6), -F.col("pos"))).alias("m")).filter(F.col("m.score") >= LEAST_SCORE)
    return inputs.join(best, "input", "left").select("input", F.coalesce("m.pos", F.lit(-1)).alias("pos"), F.col("m.inn").alias("inn"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "inn_matches").select("match_id", "input")
    return rows.join(match_names(rows, table(spark, sf_dir, "inn")), "input").select("match_id", F.col("pos").cast("int").alias("pos")).distinct()
