"""Names in text matched to a list by the token-sort ratio (LCS), or by substrings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.functions.text import strip, tokens

#: Longest name whose letters fit the bits of a BIGINT (longer ones are compared with integers of any length); most names that are broadcast to the tokens.
LONGEST, MOST_BROADCAST = 61, 50_000


def document_tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, input, token: the first occurrence of every token of a text, without regard to case."""
    rows = df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "input")).withColumn("token", F.lower("input"))
    first = rows.groupBy(key, "token").agg(F.min(F.struct("pos", "input")).alias("f"))
    return first.select(key, F.col("f.pos").alias("pos"), F.col("f.input").alias("input"), "token")


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def with_masks(names: DataFrame) -> DataFrame:
    """name (words sorted), m (its length) and, where m is at most LONGEST, masks: letter to the bits of its places."""
    df = names.select("pos", "inn").withColumn("name", _sorted_words(F.col("inn"))).withColumn("m", F.length("name")).filter("m > 0")
    letters = F.filter(F.split("name", ""), lambda c: c != "")
    bits = F.transform(F.array_distinct(letters), lambda c: F.struct(c, F.aggregate(letters, F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("i")), lambda st, d: F.struct((st["bits"] + F.when(d == c, F.call_function("shiftleft", F.lit(1).cast("bigint"), st["i"])).otherwise(0)).alias("bits"), (st["i"] + 1).alias("i")))["bits"]))
    return df.withColumn("masks", F.when(F.col("m") <= LONGEST, F.map_from_entries(bits)))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel on integers of any length."""
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    st = full
    for c in a:
        hit = st & masks.get(c, 0)
        st = ((st + hit) | (st - hit)) & full
    return len(b) - st.bit_count()


@F.pandas_udf(T.LongType())
def long_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


def lcs(token: Column, masks: Column, m: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel."""
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), m) - 1

    def step(st, c):
        hit = st.bitwiseAND(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("bigint")))
        return (st + hit).bitwiseOR(st - hit).bitwiseAND(full)

    return m - F.bit_count(F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), full, step))


def match_tokens(distinct_tokens: DataFrame, names: DataFrame, cutoff: float = 80.0) -> DataFrame:
    """token, pos, matched, score for each distinct token with a name of ratio >= cutoff; best first, then list order.

    Names are joined on length: a ratio >= c needs a length ratio of at least c/(200-c). A bound by common letters
    comes before the LCS.
    """
    low = cutoff / (200 - cutoff)
    named = with_masks(names)
    banded = named.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") * low).cast("int"), F.floor(F.col("m") / low).cast("int"))))
    if names.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        banded = F.broadcast(banded)  # then tokens stay where they are, whatever their lengths; else AQE splits hot lengths
    t = distinct_tokens.select("token").filter("token is not null").withColumn("sorted", _sorted_words(F.col("token"))).withColumn("n", F.length("sorted"))
    pairs = t.join(banded, "n")
    need = math.ceil(cutoff)
    shared = F.size(F.filter(F.split("sorted", ""), lambda c: F.map_contains_key(F.col("masks"), c)))
    short = F.when(200 * shared < need * (F.col("n") + F.col("m")), 0).otherwise(200 * lcs(F.col("sorted"), F.col("masks"), F.col("m")))
    keep = ["token", "pos", "inn", "n", "m"]
    points = pairs.filter(f"m <= {LONGEST}").select(*keep, short.cast("bigint").alias("points"))
    points = points.unionByName(pairs.filter(f"m > {LONGEST}").select(*keep, (200 * long_lcs("sorted", "name")).alias("points")))
    scored = points.filter(F.col("points") >= cutoff * (F.col("n") + F.col("m"))).withColumn("ratio", F.col("points") / (F.col("n") + F.col("m")))
    best = scored.groupBy("token").agg(F.max_by(F.struct("pos", "inn", "ratio"), F.struct("ratio", -F.col("pos"))).alias("b"))
    return best.select("token", F.col("b.pos").alias("pos"), F.col("b.inn").alias("matched"), F.bround("b.ratio", 1).alias("score"))


def match_one(inputs: DataFrame, names: DataFrame, source: str, cutoff: float = 80.0) -> DataFrame:
    """input, matched, score, source, is_valid for every distinct input; the no-match record where nothing fits."""
    rows = inputs.select("input").filter("input is not null").distinct().withColumn("token", F.lower(strip(F.col("input"))))
    hit = match_tokens(rows.filter("token != ''").select("token").distinct(), names, cutoff)
    return rows.join(hit, "token", "left").select("input", "matched", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("matched").isNotNull(), source).otherwise("none").alias("source"), F.col("matched").isNotNull().alias("is_valid"))


def match_all(docs: DataFrame, names: DataFrame, key: str = "doc_id", cutoff: float = 80.0) -> DataFrame:
    """key, pos, input, matched, score: valid matches of every text's distinct tokens; each distinct token is matched once for all texts."""
    toks = document_tokens(docs, key)
    hit = match_tokens(toks.select("token").distinct(), names, cutoff).select("token", "matched", "score")
    return toks.join(hit, "token").select(key, "pos", "input", "matched", "score")


def _grams(c: Column, lengths: Column) -> Column:
    """Every distinct substring of c of one of the lengths."""
    return F.array_distinct(F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: c.substr(i, k)))))


def match_substring(distinct_tokens: DataFrame, names: DataFrame, gram: int = 4) -> DataFrame:
    """token, matched, score 85 for the first name that holds the token or is held by it; blank names never match.

    Joined on the beginning (up to ``gram`` letters) of the shorter among the substrings of the longer, then tested;
    any number of names will do. Null and empty tokens match nothing.
    """
    listed = names.filter("trim(inn) != ''").select("pos", "inn")
    t = distinct_tokens.select("token").filter("token != ''").distinct()
    lengths = F.array(*[F.lit(k) for k in range(1, gram + 1)])
    held = listed.withColumn("key", F.explode(_grams(F.col("inn"), lengths))).join(t.withColumn("key", F.substring("token", 1, gram)), "key").filter(F.contains("inn", F.col("token")))
    holds = t.withColumn("key", F.explode(_grams(F.col("token"), lengths))).join(listed.withColumn("key", F.substring("inn", 1, gram)), "key").filter(F.contains("token", F.col("inn")))
    both = held.select("token", "pos", "inn").unionByName(holds.select("token", "pos", "inn"))
    return both.groupBy("token").agg(F.min_by("inn", "pos").alias("matched")).withColumn("score", F.lit(85.0))
