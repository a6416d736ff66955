"""Noise in text from scanned pages: words cut at line ends, misread letters, running headings and page numbers.

Line-pair classifiers (gradient-boosted trees) decide whether a hyphen at a line end cuts a word and whether
a line is furniture; they learn from the corpus itself, from whole words that are broken artificially and from
the regions that the layout step marked as headings and footers. Misread words are found among all distinct
words of the corpus: candidates come from an inverted join on letter trigrams with the frequent words (and, for
words too short to keep a trigram and words with signs among their letters, from undoing the misreadings), and
boosted trees, trained on frequent words misread artificially, choose the replacement. What is decided becomes
edits of a text; applying them gives its paragraphs.
"""

from __future__ import annotations

import collections
import math
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.llm.boost import Boosted
from foliora.llm.langid import _HEADING, _PAGE, _key_word, _line_key, heading_keys
from foliora.llm.lookalikes import INVISIBLE, look_alikes, plain
from foliora.llm.sieve import BITS, sieve
from foliora.session import cut_lineage
from foliora.sources.tables import once, table

# Letters by the signs that scanned text often has in their place.
MISREADINGS = {
    "e": ["c"], "n": ["ri"], "t": ["+"], "i": ["l", "1", "!"], "o": ["0"], "s": ["5", "$"], "u": ["ii"], "d": ["cl"], "l": ["|", "1", "I"], "g": ["9"],
    "m": ["rn"], "h": ["b"], "b": ["6"], "a": ["@"], "c": ["e"], "w": ["vv"], "z": ["2"], "q": ["9"], "B": ["8"], "S": ["5"], "O": ["0"], "I": ["l", "|", "1"],
    "ا": ["١", "|", "1"], "ه": ["٥", "5"], "و": ["9", "٩"], "ر": ["د"], "۱": ["|"],
}
HYPHENS = "-‐‑¬"
#: Least count of a word that can replace others, shortest words looked at, training words and lines (documented bounds), least probability.
FREQUENT, SHORTEST, TRAIN_WORDS, TRAIN_LINES, LEAST_P = 3, 2, 1500, 4000, 0.5
#: Misreadings in a word, the letters that one adds, and the trigrams that one can damage (a sign of two letters stands in four): one trigram more than all damage.
MOST_MISREAD, ADDED, DAMAGED = 3, 1, 4
RAREST_GRAMS = MOST_MISREAD * DAMAGED + 1
#: Words up to this length may have no trigram left after one misreading; they are looked up by undoing it.
SHORT = 5

_WORD = re.compile(r"[^\s.,;:?()\"؟،؛«»/]+")
_CUT = re.compile(rf"([^\W\d_]+)([ ]?)[{HYPHENS}]([ ]?)$")
_HEAD = re.compile(r"^([^\W\d_]+)")
_SIGN_INSIDE = re.compile(r"[a-zß-ÿآ-يی-ۓکگپچژ][0-9٠-٩۰-۹|+!$@][a-zß-ÿآ-يکگپچژی]|(?:[a-zß-ÿ]{2}|[آ-يکگپچژی]{2})[|+!$@]$")
_MIX = re.compile(r"[^\W\d_][0-9٠-٩|+!$@][^\W\d_]|[a-zا-ي][|+!$@059٥١]$|^[|١٥+059!][a-zا-ي]{3}")


@lru_cache(maxsize=300_000)
def word_form(w: str) -> str:
    """The form in which words are counted: look-alike characters unified, lower case."""
    return plain(w).strip("-'*·").casefold()


@lru_cache(maxsize=300_000)
def _odd_word(w: str) -> bool:
    """A digit or sign between small letters, or a sign at their end."""
    return not w.isalpha() and bool(_SIGN_INSIDE.search(plain(w)))


@lru_cache(maxsize=1)
def hyphen_like() -> str:
    """The hyphens and every character that looks like one."""
    return HYPHENS + "".join(sorted(c for members in look_alikes().classes().values() if set(members) & set(HYPHENS) for c in members if len(c) == 1 and c not in HYPHENS))


@lru_cache(maxsize=1)
def _line_end() -> re.Pattern:
    return re.compile(rf"[{re.escape(hyphen_like())}][\s{INVISIBLE}]*\n")


def line_cuts(lines: list[str], heads: frozenset[str] | None = None) -> list[tuple[int, int, str, str, int, int]]:
    """Possible cuts: line, line of the other part, left and right part, space before and after the hyphen. Furniture may stand between the parts."""
    out = []
    real = [k for k, x in enumerate(lines) if x.strip()]
    for pos, k in enumerate(real[:-1]):
        line = lines[k].rstrip(INVISIBLE)
        if line.rstrip()[-1:] not in hyphen_like() or not (m := _CUT.search(plain(line))) or _PAGE.match(line.strip()):
            continue
        nxt = real[pos + 1]
        for k2 in real[pos + 1 :]:
            nxt = k2
            if not _PAGE.match(lines[k2].strip()) and not (heads and _line_key(lines[k2]) in heads):
                break
        head = _HEAD.match(plain(lines[nxt]).strip())
        if head and head[1][0].islower() == head[1][0].lower().islower():
            out.append((k, nxt, m[1].casefold(), head[1].casefold(), int(bool(m[2])), int(bool(m[3]))))
    return out


def tokens_of(text: str, heads: frozenset[str] | None = None) -> tuple[list[str], list[tuple[int, int, str, str, int, int]]]:
    """Raw words of a text and its line-end cuts; parts of cut words are not words."""
    if not _line_end().search(text):
        return _WORD.findall(text), []
    words: list[str] = []
    lines = text.split("\n")
    cuts = line_cuts(lines, heads)
    last, first = {c[0] for c in cuts}, {c[1] for c in cuts}
    for k, line in enumerate(lines):
        found = _WORD.findall(line)
        words += found[k in first : len(found) - 1 if k in last and found else None]
    return words, cuts


@lru_cache(maxsize=300_000)
def repaired(word: str, target: str) -> int | None:
    """How many misreadings turn target into word; None if none do."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(target) + 1):
        for j in range(len(word) + 1):
            k = best.get((i, j))
            if k is None or k > 3:
                continue
            if i < len(target):
                if j < len(word) and target[i] == word[j]:
                    best[i + 1, j + 1] = min(best.get((i + 1, j + 1), 9), k)
                for m in MISREADINGS.get(target[i], ()):
                    m = m.casefold()
                    if word.startswith(m, j):
                        best[i + 1, j + len(m)] = min(best.get((i + 1, j + len(m)), 9), k + 1)
    return best.get((len(target), len(word)))


@lru_cache(maxsize=1)
def _origins() -> dict[str, list[str]]:
    """Letters by the sign or letters that may be a misreading of them."""
    out: dict[str, list[str]] = collections.defaultdict(list)
    for c, many in MISREADINGS.items():
        for m in many:
            if c.casefold() not in out[m.casefold()]:
                out[m.casefold()].append(c.casefold())
    return dict(out)


def _script(c: str) -> bool:
    return c > "\u0600"


def undone(word: str, odd: bool) -> list[str]:
    """Words of which this may be a misreading: all its signs and digits read as letters of its script; a short word of letters with any one of its letters (or two as one) read as another."""
    if not odd:
        return sorted({word[:i] + c + word[i + len(m) :] for m, many in _origins().items() for i in range(len(word)) if word.startswith(m, i) for c in many}) if len(word) <= SHORT else []
    signs = [i for i, c in enumerate(word) if not c.isalpha()]
    letters = [c for c in word if c.isalpha()]
    if not letters or len(signs) > MOST_MISREAD:
        return []
    arabic = 2 * sum(map(_script, letters)) > len(letters)
    choices = [[c for c in _origins().get(word[i], []) if _script(c) == arabic] for i in signs]
    out = set()
    for picked in product(*choices):
        new = list(word)
        for i, c in zip(signs, picked):
            new[i] = c
        out.add("".join(new))
    return sorted(out)


def grams(w: str) -> set[str]:
    p = f"^{w}$"
    return {p[i : i + 3] for i in range(len(p) - 2)}


#: Number of features of a pair.
PAIR = 11


def pair_features(word: str, n: int, target: str, m: int, odd: bool) -> list[float]:
    """Of a word (count n; odd: a sign stands among its small letters as printed) and a word that may stand behind it (count m, 0 where the corpus does not hold it)."""
    k = repaired(word, target)
    a, b = grams(word), grams(target)
    signs = sum(not c.isalpha() and c not in "-'’" for c in word)
    mixed = bool(_MIX.search(word))
    return [9 if k is None else k, len(a & b) / len(a | b), math.log(m + 1), math.log(n + 1), math.log((m + 1) / (n + 1)), len(word), len(word) - len(target), signs, mixed, word[:1] == target[:1], odd]


def misread(word: str, rng: random.Random, times: int = 1) -> str:
    for _ in range(times):
        places = [i for i, c in enumerate(word) if c in MISREADINGS]
        if not places:
            return word
        i = rng.choice(places)
        word = word[:i] + rng.choice(MISREADINGS[word[i]]).casefold() + word[i + 1 :]
    return word


def train_chooser(frequent: list[tuple[str, int]], codes: list[tuple[str, int]] = (), short: list[tuple[str, int]] = ()) -> Boosted:
    """frequent: a bounded sample of (word, count); codes: one of words with digits that are right; short: one of words under four letters. Misread words with their origin, seen and unseen, against near words and legitimate neighbours."""
    rng = random.Random(7)
    by_gram = collections.defaultdict(set)
    count = dict(frequent)
    for w in count:
        for g in grams(w):
            by_gram[g].add(w)

    def neighbours(w: str, most: int) -> list[str]:
        c = collections.Counter(v for g in sorted(grams(w)) for v in sorted(by_gram[g]) if v != w)
        return [v for v, _ in c.most_common(most)]

    x, y = [], []

    def add(label: int, *pair) -> None:
        x.append(pair_features(*pair))
        y.append(label)

    for w, m in frequent:
        bad = misread(w, rng, 1 + (rng.random() < 0.25))
        if bad == w or bad in count:
            continue
        n = 1 + int(rng.random() * max(1, m // 50 if rng.random() < 0.8 else m // 2))  # some are repeated in like texts
        odd = _odd_word(bad)
        add(1, bad, n, w, m, odd)
        if odd and rng.random() < 0.5:
            add(1, bad, 1, w, 0, odd)
        for v in neighbours(bad, 4):
            if v != w:
                add(0, bad, n, v, count[v], odd)
        near = neighbours(w, 40)
        for k, v in enumerate(near):  # words that are right as they are, often rare ones, and pairs of like count that a misreading would also make
            made = (repaired(w, v) or 9) <= 3
            if made and count[v] >= 3 * m:
                continue  # w may be misread itself
            if k < 3 or made:
                add(0, w, m if made else rng.choice([1, 2, 3, m]), v, count[v], False)
    small = dict(short)
    for w, m in short:
        bad = misread(w, rng)
        if bad != w and bad not in small:
            add(1, bad, 1 + int(rng.random() * (m // 300)), w, m, _odd_word(bad))
        for v in undone(w, False):
            if v in small and v != w and small[v] < 100 * m:  # both are words
                add(0, w, m, v, small[v], False)
    for w, n in codes:
        for v in undone(w, True)[:4]:
            add(0, w, n, v, 0, False)
    if not x or not any(y):
        return Boosted(trees=0).fit(np.zeros((2, PAIR)), np.array([0, 1]))
    return Boosted().fit(np.array(x), np.array(y))


def cut_features(joined: int, hyphened: int, left: int, right: int, before: int, after: int, size: int) -> list[float]:
    return [math.log(joined + 1), math.log(hyphened + 1), math.log(left + 1), math.log(right + 1), before, after, size, math.log((joined + 1) / (hyphened + 1))]


def broken(words: list[str]) -> list[tuple[str, str, int, int]]:
    """Each word broken at a random place, with a random space before or after the hyphen."""
    rng = random.Random(11)
    out = []
    for w in words:
        if len(w) >= 5 and w.isalpha():
            i = rng.randint(2, len(w) - 2)
            out.append((w[:i], w[i:], int(rng.random() < 0.3), int(rng.random() < 0.4)))
    return out


def train_cuts(words: list[tuple[str, int]], hyphened: list[tuple[str, int]], count: dict[str, int]) -> Boosted:
    """Frequent words broken artificially against words with a hyphen of their own, each also with its own count unseen."""
    rng = random.Random(13)
    x, y = [], []
    whole = dict(words)
    for a, b, before, after in broken([w for w, _ in words]):
        for joined in (whole[a + b], whole[a + b], 0):
            x.append(cut_features(joined, 0, count.get(a, 0), count.get(b, 0), before, after, len(a) + len(b)))
            y.append(1)
    repeat = max(1, len(x) // max(1, 4 * len(hyphened)))
    for w, n in hyphened:
        a, _, b = w.partition("-")
        for _ in range(min(repeat, 40)):
            h = rng.choice([n, n, n, 0])
            x.append(cut_features(count.get(a + b, 0), h, max(count.get(a, 0), h), max(count.get(b, 0), h), 0, 0, len(w) - 1))
            y.append(0)
    if not x or len(set(y)) < 2:
        return Boosted(trees=0).fit(np.zeros((2, 8)), np.array([0, 1]))
    return Boosted(trees=40).fit(np.array(x), np.array(y))


@lru_cache(maxsize=300_000)
def _key_words(raw: str) -> tuple[str, ...]:
    return tuple(_key_word(raw).split())


def key_words(line: str) -> list[str]:
    """The words of a line in their form for comparison."""
    return [w for raw in line.split() for w in _key_words(raw)]


@lru_cache(maxsize=20_000)
def heading_sets(heads: frozenset[str]) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(h.split()) for h in sorted(heads))


def likeness(words: list[str], heads: frozenset[str]) -> float:
    """Largest share of words in common with a heading (keys, words parted by spaces)."""
    own = set(words)
    return max((n / (len(own) + len(h) - n) for h in heading_sets(heads) if (n := len(own & h))), default=0.0)


def line_features(line: str, heads: frozenset[str], odds: dict[str, float]) -> list[float]:
    s = plain(line).strip()
    words = key_words(line)
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    return [likeness(words, heads), sum(odds.get(w, 0.0) for w in words) / max(1, len(words)), len(s), len(words), digits, letters, bool(_PAGE.match(s)), s[-1:] in ".!?؟", s.isupper(), sum(not c.isalnum() and not c.isspace() for c in s)]


def may_be_furniture(line: str, heads: frozenset[str], odds: dict[str, float]) -> bool:
    """Whether any kind of furniture can be predicted: like a heading, of heading words, or no words but those of a page number (two, and two numbers)."""
    words = key_words(line)
    if not words:
        return False
    if len(words) < 9 and sum([not w.isdigit() for w in words]) <= 2 and any([w[-1].isdigit() or w[0].isdigit() for w in words]):
        return True
    get = odds.get
    return sum([get(w, 0.0) for w in words]) > len(words) or (bool(heads) and likeness(words, heads) >= 0.5)


def train_lines(sample: pd.DataFrame) -> tuple[dict[str, float], dict[str, Boosted]]:
    """sample: kind (header, footer, text), text, heads. Log odds of words in headings, and one classifier for each kind of furniture."""
    lines = [(k, x, frozenset(h) if h is not None else frozenset()) for k, t, h in zip(sample["kind"], sample["text"], sample["heads"]) for x in (t or "").split("\n") if x.strip()]
    inside, outside = collections.Counter(), collections.Counter()
    for k, x, _ in lines:
        (inside if k == "header" else outside).update(set(key_words(x)))
    ni, no = sum(k == "header" for k, _, _ in lines) + 1, sum(k != "header" for k, _, _ in lines) + 1
    odds = {w: math.log((inside[w] + 0.5) / ni) - math.log((outside[w] + 0.5) / no) for w in inside if inside[w] + outside[w] >= 3}
    models = {}
    rng = random.Random(3)
    # for half of the rows no heading is known, as on leaflets whose headings were missed
    x = np.array([line_features(t, h if rng.random() < 0.7 else frozenset(), odds) for _, t, h in lines]).reshape(len(lines), 10)
    for name, kind in (("header", "header"), ("page_number", "footer")):
        y = np.array([k == kind and (kind == "header" or any(c.isdigit() for c in t)) for k, t, _ in lines], float)
        if len(y) and 0 < y.sum() < len(y):
            w = np.where(y > 0, 1.0, min(1.0, 2 * y.sum() / (len(y) - y.sum())))
            models[name] = Boosted(trees=40).fit(x, y, w)
    return odds, models


WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("odd", T.LongType())])
USES = T.StructType([T.StructField("src", T.StringType()), T.StructField("row_key", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])
SCORED = T.StructType([T.StructField("word", T.StringType()), T.StructField("target", T.StringType()), T.StructField("m", T.LongType()), T.StructField("p", T.DoubleType())])


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n (over distinct texts), copies (over all texts), odd (uses with a sign among small letters)."""

    def count(batches):
        for b in batches:
            seen: collections.Counter = collections.Counter()
            every: collections.Counter = collections.Counter()
            for t, copies in zip(b["text"], b["copies"]):
                raw = tokens_of(t)[0]
                seen.update(raw)
                if copies > 1:
                    for w in raw:
                        every[w] += copies - 1
            forms: dict[str, list[int]] = {}
            for w, n in seen.items():
                if f := word_form(w):
                    c = forms.setdefault(f, [0, 0, 0])
                    c[0] += n
                    c[1] += n + every[w]
                    c[2] += n * _odd_word(w)
            yield pd.DataFrame([(w, *c) for w, c in forms.items()], columns=WORDS.names)

    distinct = texts.filter("text is not null and text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.mapInPandas(count, WORDS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.sum("odd").alias("odd"))


def _sampled(df: DataFrame, most: int) -> list:
    return df.orderBy(F.xxhash64("word"), "word").limit(most).collect()


def candidate_pairs(counts: DataFrame) -> DataFrame:
    """word, n, odd, target, m: for every distinct word the frequent words that share one of its rarest trigrams, and the words that undoing its misreadings gives (m is 0 where the corpus does not hold one; only odd words keep those)."""
    lettered = counts.filter((F.length("word") >= SHORTEST) & F.col("word").rlike(r"\p{L}"))
    frequent = lettered.filter((F.col("copies") >= FREQUENT) & F.col("word").rlike(r"^[\p{L}\-'’\x{200c}]+$"))
    long = lettered.filter(F.length("word") >= 4)

    def with_grams(df: DataFrame, name: str) -> DataFrame:
        p = F.concat(F.lit("^"), F.col(name), F.lit("$"))
        return df.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))))

    index = with_grams(frequent.select(F.col("word").alias("target"), F.col("n").alias("m")), "target").withColumn("size", F.length("target"))
    df = index.groupBy("gram").agg(F.count("*").alias("df"))
    looked = with_grams(long.select("word", "n", "odd"), "word").join(df, "gram")
    rarest = looked.groupBy("word", "n", "odd").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram"))), 1, RAREST_GRAMS).alias("g")).withColumn("g", F.explode("g")).select("word", "n", "odd", F.col("g.gram").alias("gram"), F.explode(F.sequence(F.length("word") - MOST_MISREAD * ADDED, F.length("word"))).alias("size"))
    near = rarest.join(index, ["gram", "size"]).filter((F.col("target") != F.col("word")) & (F.levenshtein("word", "target", 2 * MOST_MISREAD) >= 0)).select("word", "n", "odd", "target", "m")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def origins(word: pd.Series, odd: pd.Series) -> pd.Series:
        return pd.Series([undone(w, bool(o)) for w, o in zip(word, odd)])

    back = lettered.filter((F.col("odd") > 0) | (F.length("word") <= SHORT)).select("word", "n", "odd", F.explode(origins("word", "odd")).alias("target"))
    back = back.join(counts.select(F.col("word").alias("target"), F.col("n").alias("m"), "copies"), "target", "left").filter((F.col("odd") > 0) | (F.col("copies") >= FREQUENT))
    return near.unionByName(back.select("word", "n", "odd", "target", F.coalesce("m", F.lit(0)).alias("m"))).distinct()


def find_misread(counts: DataFrame) -> DataFrame:
    """word, replacement, p: distinct words of the corpus that are misread forms of others."""
    usual = counts.filter((F.col("n") >= 2 * FREQUENT) & F.col("word").rlike(r"^\p{L}+$"))
    sample, short = _sampled(usual.filter("length(word) >= 4"), TRAIN_WORDS), _sampled(usual.filter(f"length(word) between {SHORTEST} and 3"), TRAIN_WORDS // 2)
    codes = _sampled(counts.filter((F.col("odd") == 0) & F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"\p{N}")), TRAIN_WORDS // 4)
    model = train_chooser(*[[(r["word"], r["n"]) for r in rows] for rows in (sample, codes, short)])

    def score(batches):
        for b in batches:
            b = b.iloc[[i for i, (w, t) in enumerate(zip(b["word"], b["target"])) if (repaired(w, t) or 9) <= MOST_MISREAD]]
            x = [pair_features(w, n, t, m, o > 0) for w, n, t, m, o in zip(b["word"], b["n"], b["target"], b["m"], b["odd"])]
            yield pd.DataFrame({"word": b["word"], "target": b["target"], "m": b["m"], "p": model.predict(np.array(x).reshape(len(x), PAIR)) if x else []})

    scored = candidate_pairs(counts).mapInPandas(score, SCORED)
    return scored.groupBy("word").agg(F.max_by(F.struct("target", "p"), F.struct("p", "m", "target")).alias("b")).filter(F.col("b.p") >= LEAST_P).select("word", F.col("b.target").alias("replacement"), F.col("b.p").alias("p"))


def find_edits(texts: DataFrame, regions: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """src, row_key, noise, line, a, b: what is wrong with each text. noise is hyphen (in line ``line`` the word a is cut and goes on with b), char (the word a stands for b), header or page_number (line ``line`` is one).

    texts: src, row_key, doc_id, text; regions: doc_id, region_type, text, from which headings and furniture are
    learned; corpus: text, in which words are counted, by default all texts and regions (where it is given, it should
    hold every word of texts: one that it lacks is never misread). Null and empty texts give no row; very long texts are read whole; repeated rows give repeated
    edits; with an empty corpus nothing is noise.
    """
    filled = texts.select("src", "row_key", "doc_id", "text").filter("text is not null and text != ''")
    counts = cut_lineage(word_counts(filled.select("text").unionByName(regions.select("text")) if corpus is None else corpus))
    bad = cut_lineage(find_misread(counts))
    wrong = sieve(bad, F.crc32(F.encode("word", "utf-8")))
    heads = cut_lineage(heading_keys(regions.filter("region_type = 'header'").select("doc_id", "text")))
    spark = texts.sparkSession

    kinds = regions.filter("region_type in ('header', 'footer', 'text_block') and text is not null and text != ''").withColumn("kind", F.when(F.col("region_type") == "text_block", "text").otherwise(F.col("region_type")))
    parts = [kinds.filter(F.col("kind") == k).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(TRAIN_LINES // 2) for k in ("header", "footer", "text")]
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(heads, "doc_id", "left").select("kind", "text", F.col("headers").alias("heads")).toPandas().sort_values(["kind", "text"])
    odds, lines = train_lines(sample)
    hyph = _sampled(counts.filter(F.col("word").rlike(r"^\p{L}+-\p{L}{2,}$") & (F.col("n") >= 2)), TRAIN_WORDS)
    plainw = _sampled(counts.filter((F.col("n") >= 2 * FREQUENT) & F.col("word").rlike(r"^\p{L}{5,}$")), TRAIN_WORDS)
    bits = {b for r in hyph for b in r["word"].split("-")}
    # the parts of the sampled words (their number is bounded by the samples), to know which are words of their own
    bits |= {part for a, b, _, _ in broken([r["word"] for r in plainw]) for part in (a, b)}
    parts_ = spark.createDataFrame([(b,) for b in sorted(bits)], "word string")
    known = {r["word"]: r["n"] for r in counts.join(F.broadcast(parts_), "word").collect()}
    cutter = train_cuts([(r["word"], r["n"]) for r in plainw], [(r["word"], r["n"]) for r in hyph], known)

    def uses(batches):
        forms: dict[str, str] = {}

        def look(raw: str) -> str:
            """The form of a word that may be misread, else nothing."""
            f = forms.get(raw)
            if f is None:
                if len(forms) > 500_000:
                    forms.clear()
                f = word_form(raw)
                f = forms[raw] = f if wrong.has(zlib.crc32(f.encode()) % BITS) else ""
            return f

        # a line of a leaflet often stands in several of its texts: each distinct one is looked at once
        memos: dict[frozenset, dict[str, tuple]] = {}

        def judge(line: str, hs: frozenset[str]) -> tuple:
            """Words of the line that may be misread, and its features where it may be furniture."""
            return tuple({f for f in map(look, _WORD.findall(line)) if f}), line_features(line, hs, odds) if may_be_furniture(line, hs, odds) else None

        for b in batches:
            out, rows, place = [], [], []
            for src, key, heads_, text in zip(b["src"], b["row_key"], b["headers"], b["text"]):
                hs = frozenset(heads_) if heads_ is not None else frozenset()
                memo = memos.get(hs)
                if memo is None:
                    if len(memos) > 500:
                        memos.clear()
                    memo = memos[hs] = {}
                elif len(memo) > 100_000:
                    memo.clear()
                misread_: set[str] = set()
                for k, line in enumerate(text.split("\n")):
                    got = memo.get(line)
                    if got is None:
                        got = memo[line] = judge(line, hs)
                    if got[0]:
                        misread_.update(got[0])
                    if got[1] is not None:
                        place.append((src, key, k))
                        rows.append(got[1])
                if _line_end().search(text):
                    words, cuts = tokens_of(text, hs)
                    out += [(src, key, "cut", k, left, right, before, after) for k, _, left, right, before, after in cuts]
                    if misread_ and cuts:  # the parts of cut words are no words
                        misread_ &= set(map(look, words))
                out += [(src, key, "word", 0, f, "", 0, 0) for f in misread_]
            if rows:
                x = np.array(rows)
                for name, model in lines.items():
                    ok = (x[:, 6] > 0) if name == "page_number" else (x[:, 0] >= 0.5) | (x[:, 1] > 1.0)
                    at = np.nonzero(ok)[0]
                    at = at[model.predict(x[at]) >= LEAST_P]
                    out += [(src, key, name, k, "", "", 0, 0) for src, key, k in (place[i] for i in at)]
            yield pd.DataFrame(out, columns=USES.names)

    used = cut_lineage(filled.join(heads, "doc_id", "left").mapInPandas(uses, USES))
    chars = used.filter("kind = 'word'").join(bad.select(F.col("word").alias("a"), F.col("replacement").alias("to")), "a").select("src", "row_key", F.lit("char").alias("noise"), "line", "a", F.col("to").alias("b"))

    # each distinct cut is looked up and judged once
    keys = {"joined": F.concat("a", "b"), "hyphened": F.concat_ws("-", "a", "b"), "ln": F.col("a"), "rn": F.col("b")}
    cuts = used.filter("kind = 'cut'").select("a", "b", "before", "after").distinct().withColumn("k", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), k.alias("word")) for n, k in keys.items()])))
    cuts = cuts.select("a", "b", "before", "after", "k.name", "k.word").join(counts.select("word", "n"), "word", "left").groupBy("a", "b", "before", "after").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in keys])

    def decide(batches):
        for b in batches:
            x = [cut_features(r.joined, r.hyphened, r.ln, r.rn, r.before, r.after, len(r.a) + len(r.b)) for r in b.itertuples()]
            p = cutter.predict(np.array(x).reshape(len(x), 8)) if x else np.zeros(0)
            yield b[p >= LEAST_P][["a", "b", "before", "after"]]

    real = cuts.mapInPandas(decide, "a string, b string, before int, after int")
    hyphens = used.filter("kind = 'cut'").join(real, ["a", "b", "before", "after"]).select("src", "row_key", F.lit("hyphen").alias("noise"), "line", "a", "b")
    furniture = used.filter("kind in ('header', 'page_number')").select("src", "row_key", F.col("kind").alias("noise"), "line", "a", "b")
    return chars.unionByName(hyphens).unionByName(furniture)


def _like_case(raw: str, form: str) -> str:
    return form.upper() if raw.isupper() and len(raw) > 1 else form.capitalize() if raw[:1].isupper() else form


def mend(text: str, edits) -> str:
    """The text in continuous paragraphs: furniture lines left out, cut words joined, misread words replaced, the lines of a paragraph (to the next blank line, section heading or row of a table) joined by spaces."""
    words = {e["a"]: e["b"] for e in edits if e["noise"] == "char"}
    gone = {e["line"] for e in edits if e["noise"] in ("header", "page_number")}
    joins = {e["line"] for e in edits if e["noise"] == "hyphen"}

    def fixed(line: str) -> str:
        def one(m: re.Match) -> str:
            raw = m[0]
            to = words.get(word_form(raw))
            if to is None:
                return raw
            core = raw.strip("-'*·")
            at = raw.find(core)
            return raw[:at] + _like_case(core, to) + raw[at + len(core) :]

        return _WORD.sub(one, line) if words else line

    paragraphs: list[list[str]] = []
    fresh, open_cut = True, False
    for k, line in enumerate(text.split("\n")):
        s = line.strip()
        if k in gone:
            continue
        if not s:
            fresh = fresh or not open_cut
            continue
        if fresh or ((_HEADING.match(s) or "|" in s) and not open_cut):
            paragraphs.append([])
        fresh = bool(_HEADING.match(s) or "|" in s)
        s = fixed(s)
        if paragraphs[-1] and (open_cut or re.search(rf"\w[{re.escape(hyphen_like())}]$", paragraphs[-1][-1])):  # a hyphen of the word's own stays
            paragraphs[-1][-1] += s
        else:
            paragraphs[-1].append(s)
        open_cut = k in joins
        if open_cut:
            paragraphs[-1][-1] = re.sub(rf"\s*[{re.escape(hyphen_like())}][\s{INVISIBLE}]*$", "", paragraphs[-1][-1])
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


EDIT = "array<struct<noise:string,line:int,a:string,b:string>>"


def repair_texts(texts: DataFrame, regions: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of texts (src, row_key, doc_id, text and any other column) with ``edits`` and ``repaired``.

    Rows are told apart by src and row_key; repeated ones get the same result. Null texts stay null and empty
    ones empty, with no edits; very long texts are repaired whole; columns named edits or repaired are replaced.
    """
    edits = find_edits(texts.select("src", "row_key", "doc_id", "text").dropDuplicates(["src", "row_key"]), regions, corpus).distinct()
    per = edits.groupBy("src", "row_key").agg(F.array_sort(F.collect_list(F.struct("noise", "line", "a", "b"))).alias("edits"))
    joined = texts.drop("edits", "repaired").join(per, ["src", "row_key"], "left").withColumn("edits", F.coalesce("edits", F.expr(f"cast(array() as {EDIT})")))

    def apply(batches):
        for b in batches:
            yield b.assign(repaired=[mend(t, e) if t else t for t, e in zip(b["text"], b["edits"])])

    return joined.mapInPandas(apply, T.StructType([*joined.schema.fields, T.StructField("repaired", T.StringType())]))


def p6_texts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    regions = once(table(spark, sf_dir, "regions").select("region_key", "doc_id", "region_type", "text").filter("text is not null and text != ''"), "region_key")
    results = table(spark, sf_dir, "results").select(F.lit("results").alias("src"), F.col("result_id").alias("row_key"), "doc_id", F.col("full_text_combined").alias("text"))
    blocks = regions.filter("region_type = 'text_block'").select(F.lit("regions").alias("src"), F.col("region_key").alias("row_key"), "doc_id", "text")
    return blocks.unionByName(results), regions


def p6_found(spark, sf_dir: str) -> DataFrame:
    texts, regions = p6_texts(spark, sf_dir)
    return find_edits(texts, regions, regions).select("src", "row_key", "noise").distinct()  # the combined texts are made of the regions' ones


def p6_repaired(spark, sf_dir: str) -> DataFrame:
    texts, regions = p6_texts(spark, sf_dir)
    return repair_texts(once(texts, "src", "row_key"), regions, regions).select("src", "row_key", "repaired")
