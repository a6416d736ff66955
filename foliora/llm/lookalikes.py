"""Text that looks the same brought to one form of characters.

Look-alike classes are the transitive closure (union-find) of pairs of strings and code points: Unicode's own
font, width, contextual and ligature forms, composed and decomposed letters, letters of other scripts that
share a shape, Arabic and Persian letters that share one, and characters without shape. In every sentence the
representative of a class is its member most frequent in the sentence's language over the distinct texts of the
corpus, and a multi-pattern automaton rewrites the text greedily, longest member first. A text is found where
this changes it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.llm.langid import Model, heading_keys, sentence_spans, stretches
from foliora.session import cut_lineage
from foliora.sources.tables import once, table

# Letters of other scripts by the Latin letter of the same shape.
CYRILLIC_SHAPES = dict(zip("авеосрухіјѕһԁԛԝАВЕЅІЈКМНОРСТУХҮԌ", "aBeocpyxijshdqwABESIJKMHOPCTYXYG"))
CYRILLIC_SHAPES.update({"в": "ʙ", "к": "ĸ", "м": "ᴍ", "н": "ʜ", "т": "ᴛ", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï"})
GREEK_SHAPES = dict(zip("οριναυκϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "opivauĸcjABEZHIKMNOPTYX"))
# Greek letters that stand alone in scientific terms.
SCIENTIFIC = set("αβγδεηθκλμνπρστφχψωΔΣΩ") - set("νρ")
# Arabic and Persian letters of one shape.
ARABIC_SHAPES = [("ي", "ی"), ("ى", "ی"), ("ك", "ک"), ("ه", "ہ"), ("ه", "ە"), ("ه", "ھ"), ("ة", "ۃ"), ("ي", "ې"), ("و", "ۆ")]
INVISIBLE = "\u00ad\u034f\u061c\u115f\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
OWN = {"ar": set("يىكهةو"), "fa": set("یکهةو")}
SPACE_SHAPES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
KINDS = ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
LETTER_RUN = re.compile(r"[^\W\d_]+", re.U)


class Union:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(maxsize=1)
def look_alikes() -> Union:
    """All pairs that Unicode states and the fixed shapes, closed transitively."""
    u = Union()
    for i in range(0x80, 0x1FFFF):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        d = unicodedata.decomposition(c)
        if not d:
            continue
        kind = d.split(" ")[0]
        plain = unicodedata.normalize("NFKC", c)
        if kind in KINDS or 0xFB00 <= i < 0xFB07:
            if plain != c and plain.strip():
                u.join(c, plain)
        elif not kind.startswith("<") and unicodedata.normalize("NFC", c) == c:
            u.join(c, unicodedata.normalize("NFD", c))
    for a, b in [*CYRILLIC_SHAPES.items(), *GREEK_SHAPES.items(), *ARABIC_SHAPES]:
        u.join(a, b)
    for c in SPACE_SHAPES:
        u.join(" ", c)
    return u


@lru_cache(maxsize=1)
def plain_of() -> dict[str, str]:
    """Each member of a class to a plain member without regard to language: ASCII, else shortest, else first."""
    out = {}
    for members in look_alikes().classes().values():
        rep = min(members, key=lambda m: (not m.isascii(), unicodedata.normalize("NFKC", m) != m, any(unicodedata.combining(c) for c in m), len(m), m))
        for m in members:
            if m != rep:
                out[m] = rep
    for c in INVISIBLE:
        out[c] = ""
    return out


@lru_cache(maxsize=8)
def automaton(pairs: tuple[tuple[str, str], ...]):
    a = ahocorasick.Automaton()
    for member, rep in pairs:
        a.add_word(member, (len(member), rep))
    a.make_automaton()
    return a


def rewrite(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    """Left to right, the longest member at each place replaced by its representative."""
    if text.isascii() or not pairs:
        return text
    out, at = [], 0
    for end, (n, rep) in automaton(pairs).iter_long(text):
        start = end - n + 1
        if start >= at:
            out += [text[at:start], rep]
            at = end + 1
    return "".join(out) + text[at:]


@lru_cache(maxsize=1)
def _plain_pairs() -> tuple[tuple[str, str], ...]:
    return tuple(sorted(plain_of().items()))


def plain(text: str | None) -> str:
    """One form for comparison, whatever the language."""
    return rewrite(text, _plain_pairs()) if text else ""


def representatives(counts: dict[tuple[str, str], int], lang: str) -> tuple[tuple[str, str], ...]:
    """(member, representative) in one language: the member most frequent there; of equally frequent ones ASCII, then composed letters, then order.

    Forms that Unicode itself resolves never represent, nor do letters of a script that none of the languages
    is written in if there are others. Arabic letters of one shape are each proper outside Arabic and Persian sentences.
    """
    own = OWN.get(lang)
    letters = {c for pair in ARABIC_SHAPES for c in pair}
    pairs = []
    for members in look_alikes().classes().values():
        if own and (keep := own & set(members)):
            reps, rest = keep, [m for m in members if m not in keep]
            rep = max(sorted(reps), key=lambda m: counts.get((lang, m), 0))
        elif not own and letters & set(members):
            pairs += [(m, k) for m in members if (k := unicodedata.normalize("NFKC", m)) != m]
            continue
        else:
            stable = [m for m in members if unicodedata.normalize("NFKC", m) == m] or members
            stable = [m for m in stable if not _FOREIGN.search(m)] or stable
            rep = max(sorted(stable, key=lambda m: (not m.isascii(), any(unicodedata.combining(c) for c in m), m)), key=lambda m: counts.get((lang, m), 0) if len(m) == 1 else 0)
            rest = [m for m in members if m != rep]
        pairs += [(m, rep) for m in rest]
    return tuple(sorted(pairs))


_FOREIGN = re.compile("[\u0370-\u052f]")
_ODD_SPACE = re.compile("[" + SPACE_SHAPES + "]")
_HIDDEN = re.compile("[" + INVISIBLE + "]")
JOINER = "\u200c"
JOINED = re.compile("[^\\W\\d_]+(?:\u200c[^\\W\\d_]*)+")


def one_form(word: str, lang: str, pairs: tuple[tuple[str, str], ...], joiners: frozenset[str]) -> str:
    """A printed word in the characters of its sentence's language. Scientific Greek letters that stand alone and the joiners of proper Persian spelling stay."""
    if word.isascii():
        return word
    hidden = [] if lang != "fa" or JOINER not in word else [JOINER]
    bare = "".join(c for c in word if c not in INVISIBLE or c in hidden)
    bare, parts, at = unicodedata.normalize("NFC", bare), [], 0
    for m in LETTER_RUN.finditer(bare):
        if all(c in SCIENTIFIC for c in m[0]):
            parts += [rewrite(bare[at : m.start()], pairs), m[0]]
            at = m.end()
    out = "".join(parts) + rewrite(bare[at:], pairs)
    if hidden:
        parts, at = [], 0
        for m in JOINED.finditer(out):
            parts += [out[at : m.start()].replace(JOINER, ""), m[0] if m[0] in joiners else m[0].replace(JOINER, "")]
            at = m.end()
        out = "".join(parts) + out[at:].replace(JOINER, "")
    return out


# Persian prefixes and endings that are written with a joiner.
PREFIXES, ENDINGS = set("می نمی بی به هم کم پیش پس باز".split()), set("ها های هایی ام ات اش ای اید ایم اند تر ترین".split())
#: Least share of a joined spelling among it and the same without joiners, and the distinct texts from which it needs no like form.
JOINED_SHARE, JOINED_TEXTS = 0.5, 3


def proper_joined(joined: DataFrame) -> DataFrame:
    """form: the joined spellings that are proper, of form, n (distinct texts with it), m (distinct texts with the same unjoined).

    One in few texts also needs a usual prefix or ending, or another one that begins or ends with it (words cut at a
    line) or has its first or last part.
    """
    usual = joined.filter(~F.endswith("form", F.lit(JOINER)) & (F.col("n") >= JOINED_SHARE * (F.col("n") + F.col("m")))).select("form", "n")
    sure, few = usual.filter(F.col("n") >= JOINED_TEXTS).select("form"), usual.filter(F.col("n") < JOINED_TEXTS).select("form")
    spark = joined.sparkSession
    first = lambda c: F.split(c, JOINER)[0]
    last = lambda c: F.element_at(F.split(c, JOINER), -1)
    firsts = sure.select(first(F.col("form")).alias("part")).unionByName(spark.createDataFrame([(p,) for p in sorted(PREFIXES)], "part string")).distinct()
    lasts = sure.select(last(F.col("form")).alias("part")).unionByName(spark.createDataFrame([(p,) for p in sorted(ENDINGS)], "part string")).distinct()
    n = F.length("form")
    pieces = sure.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.array(F.col("form").substr(F.lit(1), i), F.col("form").substr(i, n))))).alias("form")).filter(F.contains("form", F.lit(JOINER))).distinct()
    held = few.withColumn("part", first(F.col("form"))).join(firsts, "part", "left_semi").select("form")
    held = held.unionByName(few.withColumn("part", last(F.col("form"))).join(lasts, "part", "left_semi").select("form")).unionByName(few.join(pieces, "form", "left_semi"))
    return sure.unionByName(held).distinct()


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("form", T.StringType()), T.StructField("n", T.LongType())])
UNIFIED = T.StructType([T.StructField("text", T.StringType()), T.StructField("strange", T.BooleanType())])
#: Most joined spellings that every task holds; if there are more, each text gets its own by a join.
MOST_FORMS = 500_000


@lru_cache(maxsize=1)
def members() -> frozenset[str]:
    """The characters that belong to a class: the only ones whose counts matter, a fixed number."""
    return frozenset(c for of in look_alikes().classes().values() for c in of if len(c) == 1)


def character_counts(texts: DataFrame, model: Model) -> DataFrame:
    """lang, form, n over the distinct texts: characters that have look-alikes, by language of their sentence; and words of Persian sentences (form begins with a space), by distinct texts."""
    known = members()

    def count(batches):
        import collections

        for b in batches:
            seen: collections.Counter = collections.Counter()
            placed = [(k, text[a:z]) for k, text in enumerate(b["text"]) if text for a, z in sentence_spans(text)]
            by_lang: dict[str, list[str]] = {}
            words: dict[int, set[str]] = {}
            for (k, s), lang in zip(placed, model.languages([s for _, s in placed])):
                by_lang.setdefault(lang, []).append(s)
                if lang == "fa":
                    own = words.setdefault(k, set())
                    own.update(LETTER_RUN.findall(s))
                    own.update(JOINED.findall(s))
            for lang, own in by_lang.items():
                seen.update({(lang, c): n for c, n in collections.Counter("\n".join(own)).items() if c in known})
            for own in words.values():
                seen.update(("fa", " " + w) for w in own)
            yield pd.DataFrame([(g, c, n) for (g, c), n in seen.items()], columns=COUNTS.names)

    return texts.select("text").distinct().mapInPandas(count, COUNTS).groupBy("lang", "form").agg(F.sum("n").alias("n"))


def own_joiners(texts: DataFrame, proper: DataFrame) -> DataFrame:
    """The texts with ``joiners``: the proper joined spellings among their words."""
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[\\p{{L}}\\p{{M}}]+(?:{JOINER}[\\p{{L}}\\p{{M}}]*)+"), F.lit(0)))
    hashed = texts.withColumn("__text", F.xxhash64("text"))
    used = hashed.filter(F.contains("text", F.lit(JOINER))).select("__text", F.explode(runs).alias("printed"))

    @F.pandas_udf(T.StringType())
    def unified(printed: pd.Series) -> pd.Series:
        return printed.map(lambda w: one_form(w, "fa", representatives({}, "fa"), frozenset([w])))

    per = used.distinct().join(proper, F.col("printed") == F.col("form"), "left_semi").unionByName(used.select("__text", unified("printed").alias("printed")).distinct().join(proper, F.col("printed") == F.col("form"), "left_semi"))
    per = per.groupBy("__text").agg(F.collect_set("printed").alias("joiners"))
    return hashed.join(per, "__text", "left").drop("__text")


def unify(texts: DataFrame, model: Model, most_forms: int = MOST_FORMS) -> DataFrame:
    """The input rows with ``plain`` (one form) and ``strange`` (did the rewriting change any character).

    texts needs a column text, and may have headers (array of the headings of the text's pages). Two passes: counts of characters by language over all distinct texts, then the
    rewriting. Null and empty texts stay as they are and are not strange; very long texts are read whole;
    of members with equal counts the plain one counts.
    """
    counted = cut_lineage(character_counts(texts, model))
    words = counted.filter("form like ' _%'").select(F.substring("form", 2, 1 << 30).alias("form"), "n")
    bare = words.select(F.col("form").alias("bare"), F.col("n").alias("m"))
    joined = words.filter(F.contains("form", F.lit(JOINER))).withColumn("bare", F.replace("form", F.lit(JOINER), F.lit(""))).join(bare, "bare", "left").select("form", "n", F.coalesce("m", F.lit(0)).alias("m"))
    proper = cut_lineage(proper_joined(joined))
    # characters with look-alikes in a handful of languages: bounded by Unicode
    counts = {(r["lang"], r["form"]): r["n"] for r in counted.filter("form not like ' _%'").collect()}
    everywhere = proper.count() <= most_forms
    joiners = frozenset(r["form"] for r in proper.collect()) if everywhere else frozenset()
    reps = {lang: representatives(counts, lang) for lang in {lang for lang, _ in counts} | {""}}

    def apply(batches):
        words: dict = {}

        def unified(s: str, lang: str, own: frozenset[str]) -> str:
            """Word by word, each distinct one rewritten once; the automaton rewrites no member with a space inside."""
            if s.isascii():
                return s
            parts = re.split(r"(\s+)", _ODD_SPACE.sub(" ", s))
            for k, w in enumerate(parts):
                if w and not w.isascii():
                    if own and JOINER in w:  # judged by the text's own joined spellings
                        parts[k] = one_form(w, lang, reps.get(lang, reps[""]), own)
                        continue
                    key = (lang, w)
                    if key not in words:
                        if len(words) > 200_000:
                            words.clear()
                        words[key] = one_form(w, lang, reps.get(lang, reps[""]), joiners)
                    parts[k] = words[key]
            return "".join(parts)

        def between(s: str) -> str:
            return s if s.isascii() else _HIDDEN.sub("", _ODD_SPACE.sub(" ", s))

        for b in batches:
            new = []
            headers = b["headers"] if "headers" in b else [None] * len(b)
            placed = [stretches(t, set(h) if h is not None else set()) if t and not t.isascii() else [] for t, h in zip(b["text"], headers)]
            told = iter(model.languages([s for t, spans in zip(b["text"], placed) for a, z in spans if not (s := t[a:z]).isascii()]))
            own_sets = [frozenset(j) if j is not None else frozenset() for j in b["joiners"]] if "joiners" in b else [frozenset()] * len(b)
            for text, spans, own in zip(b["text"], placed, own_sets):
                if not text or text.isascii():
                    new.append(text)
                    continue
                parts, at = [], 0
                for a, z in spans:
                    s = text[a:z]
                    parts += [between(text[at:a]), s if s.isascii() else unified(s, next(told), own)]
                    at = z
                new.append("".join(parts) + between(text[at:]))
            yield b.drop(columns=[] if everywhere else ["joiners"]).assign(plain=new, strange=[bool(t) and t != p for t, p in zip(b["text"], new)])

    schema = T.StructType([*[f for f in texts.schema.fields if f.name not in ("plain", "strange")], T.StructField("plain", T.StringType()), T.StructField("strange", T.BooleanType())])
    return (texts if everywhere else own_joiners(texts, proper)).mapInPandas(apply, schema)


def p4_texts(spark, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "regions")
    heads = heading_keys(regions.filter("region_type = 'header'").select("doc_id", "text"))
    regions = regions.select(F.lit("regions").alias("src"), F.col("region_key").alias("row_key"), "doc_id", "text").filter("text is not null and text != ''")
    results = table(spark, sf_dir, "results").select(F.lit("results").alias("src"), F.col("result_id").alias("row_key"), F.lit(None).cast("string").alias("doc_id"), F.col("full_text_arabic").alias("text")).filter("text is not null and text != ''")
    return once(regions.unionByName(results), "src", "row_key").join(heads, "doc_id", "left").drop("doc_id")


def p4_found(spark, sf_dir: str) -> DataFrame:
    from foliora.llm.langid import fitted

    return unify(p4_texts(spark, sf_dir), fitted(spark, sf_dir)).filter("strange").select("src", "row_key").distinct()
