"""Language of documents and of each stretch of one language in them.

Nearest-centroid classification: sentences become normalised TF-IDF vectors of words and letter trigrams; the
labelled training sentences of each language are clustered into several centroids (spherical k-means); a
sentence takes the language of the nearest centroid by cosine, unless every centroid is too far. How far is too far
is calibrated, for each language and length of sentence, on held-out sentences of the language. Training
labels may be wrong: sentences that the first fit gives to another language are left out of the second.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.sources.tables import table

LANGUAGES = ("ar", "de", "en", "es", "fa", "fr")
ARABIC_SCRIPT = {"ar", "fa"}
#: Dimensions of the hashed vectors, centroids for each language, training sentences for each language of each table (a documented bound), least cosine.
DIM, CENTROIDS, TRAIN_SENTENCES, REJECT = 6144, 4, 800, 0.04
#: Lengths in words at which sentences are told apart for rejection; a sentence is too far below SLACK times the cosine that all but FAR of at least HELD held-out sentences reach; parts of the training sentences that are held out in turn; share of the best cosine from which a language is about as near.
LENGTHS, FAR, SLACK, HELD, FOLDS, ABOUT = (6, 10, 20), 0.005, 0.75, 30, 4, 0.9
# Language names and codes by the code of two letters.
CODES = {"ar": "ar ara arabic", "de": "de deu ger german", "en": "en eng english", "es": "es spa spanish", "fa": "fa fas per pes prs persian farsi", "fr": "fr fra fre french"}
CODE_OF = {c: k for k, v in CODES.items() for c in v.split()}

_FOLD = str.maketrans({"ی": "ي", "ى": "ي", "ک": "ك", "ہ": "ه", "أ": "ا", "إ": "ا", "آ": "ا", "ة": "ه", "ؤ": "و", "ئ": "ي"})
_END = re.compile(r"(?<=[.!?؟])[\s\u200b-\u200f\ufeff\u00ad\u2060]+|\n\s*\n|\s+/\s+")
_HEADING = re.compile(r"^\s*[0-9٠-٩۰-۹]+[.)]\s+\S[^.!?؟]{0,60}$")
_PAGE = re.compile(r"^[\W_]*(?:(?:page|p|pg|seite|s|página|pág|pagina|صفحة|صفحه|ص)?[\W_]*[0-9٠-٩۰-۹]+[\W_]*(?:(?:of|de|von|sur|من|از)?[\W_]*[0-9٠-٩۰-۹]+)?)[\W_]*$", re.I)


def skeleton(text: str) -> str:
    """A form for comparison in which look-alike characters are one: lower case, no marks, no joiners, one yeh and kaf."""
    from foliora.llm.lookalikes import plain

    s = plain(text).casefold().translate(_FOLD)
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) not in ("Mn", "Cf"))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; blank lines and a stroke between spaces also end one. Together they hold all but white space."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def stretches(text: str, headers: set[str]) -> list[tuple[int, int]]:
    """Sentence spans in which every repeated page heading is a span of its own."""
    if not headers or "\n" not in text:
        return sentence_spans(text)
    out, at, start = [], 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and _line_key(line) in headers:
            out += [(start + a, start + z) for a, z in sentence_spans(text[start:at])]
            out.append((at, end))
            start = end
        at = end + 1
    return out + [(start + a, start + z) for a, z in sentence_spans(text[start:])]


def is_furniture(line: str) -> bool:
    """A section heading or a line with only a page number."""
    return bool(_PAGE.match(line) or _HEADING.match(line))


# Letters that only Arabic or only Persian spelling has.
_TELLING = set("ةىيكأإؤ" + "یکگپچژ")
_RAW = re.compile(r"[^\s.,;:!?؟،()/|]+")
_TOKEN = re.compile(r"[^\W\d_]+", re.U)


@lru_cache(maxsize=300_000)
def _word_features(raw: str) -> tuple[int, ...]:
    """Hashed words and letter trigrams of one printed word; digits take no part."""
    ids: list[int] = []
    for word in _TOKEN.findall(skeleton(raw)):
        padded = f"^{word}$"
        grams = {padded[i : i + 3] for i in range(len(padded) - 2)}
        ids += [zlib.crc32(g.encode()) % DIM for g in [*[f"w:{word}"] * 3, *grams]]
    ids += [zlib.crc32(f"l:{c}".encode()) % DIM for c in raw if c in _TELLING]
    return tuple(ids)


def features(text: str) -> np.ndarray:
    """Counts of the hashed features; a word's features share the root of their number, so that long names do not rule."""
    ids: list[int] = []
    weights: list[float] = []
    for w in _RAW.findall(text):
        f = _word_features(w)
        ids += f
        weights += [max(1, len(f)) ** -0.5] * len(f)
    return np.bincount(np.asarray(ids, dtype=np.int64), weights, minlength=DIM).astype(np.float32) if ids else np.zeros(DIM, np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def length_class(text: str) -> int:
    return int(np.searchsorted(LENGTHS, len(_RAW.findall(text)), "right"))


_ARABIC = re.compile("[\u0620-\u065f\u066e-\u06d3\u06fa-\u06ff\ufb50-\ufdff\ufe70-\ufefc]+")


class Model:
    """idf of the dimensions and the centroids with their languages; small and independent of the corpus' size."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str]) -> None:
        self.idf, self.centroids, self.langs = idf, centroids, langs
        self.least: dict[tuple[str, int], float] = {}
        self.order = sorted(set(langs))
        self._known: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_rows": []}

    def _row(self, raw: str) -> int:
        """Each distinct printed word's share of the cosines (numerators by centroid, then its square norm), computed once."""
        k = self._known.get(raw)
        if k is None:
            if len(self._rows) > 300_000:
                self._known.clear()
                self._rows.clear()
            f = _word_features(raw)
            ids, n = np.unique(np.asarray(f, dtype=np.int64), return_counts=True)
            v = self.idf[ids] * n * max(1, len(f)) ** -0.5
            k = self._known[raw] = len(self._rows)
            self._rows.append(np.append(self.centroids[:, ids] @ v, v @ v).astype(np.float32))
        return k

    def scores(self, texts: list[str]) -> np.ndarray:
        """Best cosine of each language (columns in self.order); a text's square norm is the sum of its words' ones."""
        out = np.zeros((len(texts), len(self.order)), np.float32)
        groups = [[i for i, h in enumerate(self.langs) if h == g] for g in self.order]
        for a in range(0, len(texts), 2048):
            if len(self._rows) > 250_000:
                self._known.clear()
                self._rows.clear()
            ids, starts, at = [], [], []
            for i, t in enumerate(texts[a : a + 2048]):
                words = _RAW.findall(t)
                if words:
                    starts.append(len(ids))
                    at.append(a + i)
                    ids += [self._row(w) for w in words]
            if not ids:
                continue
            distinct, where = np.unique(np.asarray(ids), return_inverse=True)
            rows = np.stack([self._rows[k] for k in distinct])[where]
            sums = np.add.reduceat(rows, starts, axis=0)
            sims = sums[:, :-1] / np.maximum(np.sqrt(sums[:, -1:]), 1e-9)
            for k, g in enumerate(groups):
                out[at, k] = sims[:, g].max(axis=1)
        return out

    def classify(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence); None where every centroid is too far or the script rules the language out."""
        if not texts:
            return []
        s = self.scores(texts)
        out = []
        for t, row in zip(texts, s):
            arabic = sum(map(len, _ARABIC.findall(t)))
            letters = sum(map(len, _TOKEN.findall(t)))
            mine = [k for k, g in enumerate(self.order) if (g in ARABIC_SCRIPT) == (arabic * 2 > letters)]
            if not letters or not mine:
                out.append((None, 0.0))
                continue
            ranked = sorted(mine, key=lambda k: -row[k])
            best, second = row[ranked[0]], row[ranked[1]] if len(ranked) > 1 else 0.0
            k = length_class(t)
            # of languages about as near, the first that is near enough for its own sentences
            near = [self.order[i] for i in ranked if row[i] >= ABOUT * best and row[i] >= max(REJECT, self.least.get((self.order[i], k), 0.0))]
            out.append((near[0] if near else None, float(best / (best + second)) if best > 0 else 0.0))
        return out

    def nearest(self, texts: list[str], langs) -> list[tuple[str, int, float]]:
        """Language, length and best cosine of the sentences that are given to their language."""
        s = self.scores(texts)
        return [(g, length_class(t), float(row.max())) for t, g, row in zip(texts, langs, s) if self.order[int(row.argmax())] == g]

    def calibrate(self, held_out: list[tuple[str, int, float]]) -> None:
        """Sets how near a sentence of each language and length must be."""
        seen: dict[tuple[str, int], list[float]] = {}
        for g, k, best in held_out:
            seen.setdefault((g, k), []).append(best)
        self.least = {key: SLACK * float(np.quantile(v, FAR)) for key, v in seen.items() if len(v) >= HELD}

    def spellings(self, texts: list[str]) -> list[str]:
        """ar, fa or latin: the spelling that each text follows. Only Arabic script needs the classifier; a doubtful or short text goes by the letters that only one spelling has."""
        out = ["latin"] * len(texts)
        arabic = [i for i, t in enumerate(texts) if not t.isascii() and _ARABIC.search(t) and 2 * sum(map(len, _ARABIC.findall(t))) > sum(map(len, _TOKEN.findall(t)))]
        if not arabic or not ARABIC_SCRIPT <= set(self.order):
            return [out[i] if i not in set(arabic) else "ar" for i in range(len(texts))]
        s = self.scores([texts[i] for i in arabic])
        ar, fa = s[:, self.order.index("ar")], s[:, self.order.index("fa")]
        sure = np.maximum(ar, fa) / np.maximum(ar + fa, 1e-9) >= DOUBT
        for k, i in enumerate(arabic):
            t = texts[i]
            g = "fa" if fa[k] > ar[k] else "ar"
            if not sure[k] or t.count(" ") + t.count("\n") < 6:
                f, a = sum(t.count(x) for x in "یکگپچژ"), sum(t.count(x) for x in "يكىةأإ")
                g = "fa" if f > a else "ar" if a > f else g
            out[i] = g
        return out

    def languages(self, texts: list[str]) -> list[str]:
        """The language of each text: ar or fa as by its spelling, else the nearest Latin one; empty where none is near."""
        out = self.spellings(texts)
        latin = [i for i, g in enumerate(out) if g == "latin"]
        columns = [k for k, g in enumerate(self.order) if g not in ARABIC_SCRIPT]
        if not latin or not columns:
            return ["" if g == "latin" else g for g in out]
        s = self.scores([texts[i] for i in latin])[:, columns]
        for i, k, best in zip(latin, s.argmax(axis=1), s.max(axis=1)):
            out[i] = self.order[columns[k]] if best >= REJECT else ""
        return out


def fit(sentences: pd.DataFrame, seed: int = 0) -> Model:
    """sentences: text, lang. Each of FOLDS parts is held out in turn for the distances at which sentences are rejected; the model learns from all. Deterministic for the same rows."""
    x = np.empty((len(sentences), DIM), np.float32)
    for k, t in enumerate(sentences["text"]):
        x[k] = features(t)
    y = sentences["lang"].to_numpy()
    best: list[tuple[str, int, float]] = []
    for k in range(FOLDS):
        fold = np.arange(len(y)) % FOLDS == k
        if fold.any() and set(y[~fold]) == set(y):
            best += _fit(x, y, seed, ~fold).nearest(list(sentences["text"][fold]), y[fold])
    model = _fit(x, y, seed)
    model.calibrate(best)
    return model


def _fit(x: np.ndarray, y: np.ndarray, seed: int, rows: np.ndarray | None = None) -> Model:
    """Of the counts x, which are weighted in place, or of some rows of them, which are copied."""
    v, y = (x, y) if rows is None else (x[rows], y[rows])
    idf = np.log((1 + len(v)) / (1 + np.count_nonzero(v, axis=0))).astype(np.float32)
    v *= idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-9)
    keep = np.ones(len(v), bool)
    for _ in range(2):
        rng = np.random.default_rng(seed)
        cents, langs = [], []
        for g in sorted(set(y)):
            rows = v[(y == g) & keep]
            if not len(rows):
                continue
            k = min(CENTROIDS, len(rows))
            c = rows[rng.choice(len(rows), k, replace=False)]
            for _ in range(8):
                near = (rows @ c.T).argmax(axis=1)
                c = _unit(np.stack([rows[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(k)]))
            cents.append(c)
            langs += [g] * k
        model = Model(idf, np.concatenate(cents).astype(np.float32), langs)
        if len(cents) < 2:
            break
        # wrong labels show as sentences nearer to the mean of another language
        means = _unit(np.stack([v[(y == g) & keep].sum(axis=0) for g in model.order]))
        keep = np.array([model.order[i] for i in (v @ means.T).argmax(axis=1)]) == y
    return model


def training_sentences(spark, sf_dir: str, most: int = TRAIN_SENTENCES) -> pd.DataFrame:
    """At most ``most`` sentences for each language of each table (results' two sides and labelled documents): those of smallest hash from as many distinct texts of smallest hash, read whole."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    res = table(spark, sf_dir, "results")
    sides = res.select(F.col("full_text_english").alias("text"), F.lit("en").alias("lang")).unionByName(res.select(F.col("full_text_arabic").alias("text"), F.lit("ar").alias("lang")))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv]), F.split(F.lower(F.trim("lang")), "[-_]")[0])
    both = docs.withColumn("of", F.lit("documents")).unionByName(sides.withColumn("of", F.lit("results")))
    texts = both.withColumn("lang", code).filter("lang is not null and length(text) >= 25").select("lang", "of", F.xxhash64("text").alias("whole"), "text")
    # texts of smallest hash first, told apart by their hashes alone: copies neither travel nor crowd out others
    smallest = texts.select("lang", "of", "whole").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang", "of").orderBy("whole"))).filter(F.col("k") <= most).groupBy("lang", "of").agg(F.max("whole").alias("last")).collect()
    if not smallest:
        return pd.DataFrame({"text": [], "lang": []})
    taken = texts.filter(F.greatest(F.lit(False), F.lit(False), *[(F.col("lang") == r["lang"]) & (F.col("of") == r["of"]) & (F.col("whole") <= r["last"]) for r in smallest])).groupBy("lang", "of", "whole").agg(F.min("text").alias("text"))
    sent = taken.select("lang", "of", "whole", F.explode(F.split("text", r"(?<=[.!?؟])\s+|\n")).alias("text")).filter("length(text) >= 25").withColumn("h", F.xxhash64("whole", "text"))
    picked = sent.withColumn("k", F.row_number().over(Window.partitionBy("lang", "of").orderBy("h", "text"))).filter(F.col("k") <= most)
    return picked.select("text", "lang").toPandas().sort_values(["lang", "text"]).reset_index(drop=True)


def fitted(spark, sf_dir: str) -> Model:
    return fit(training_sentences(spark, sf_dir))


#: Confidence under which letters decide between Arabic and Persian.
DOUBT = 0.58
SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
#: Least words of a sentence, and least confidence of a language that only part of the text has.
LEAST_WORDS, LEAST_CONFIDENCE = 3, 0.55


@lru_cache(maxsize=300_000)
def _key_word(raw: str) -> str:
    return re.sub(r"[\W_]+", " ", skeleton(raw)).strip()


def _line_key(line: str) -> str:
    return " ".join(k for k in map(_key_word, line.split()) if k)


def without_furniture(text: str, headers: set[str]) -> str:
    """The text with page numbers, section headings and repeated page headings blanked, every character in its place."""
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if s and (is_furniture(s) or (headers and _line_key(s) in headers)):
            line = " " * len(line)
        out.append(line)
    return "\n".join(out)


def segments(text: str | None, headers, model: Model) -> list[tuple[int, int, str, float]]:
    """Stretches of sentences of one language: (start, end, language, confidence)."""
    if not text:
        return []
    body = without_furniture(text, set(headers) if headers is not None else set())
    spans = [(a, z) for a, z in sentence_spans(body) if len(_TOKEN.findall(body[a:z])) >= LEAST_WORDS]
    out: list[list] = []
    got = model.classify([body[a:z] for a, z in spans])
    sure = [g for g, c in got if g and c >= LEAST_CONFIDENCE]
    for (a, z), (g, c) in zip(spans, got):
        if g is None:
            continue
        if c < LEAST_CONFIDENCE:  # a doubtful sentence goes with the sure ones of its script, if there are any
            same = [h for h in sure if (h in ARABIC_SCRIPT) == (g in ARABIC_SCRIPT)]
            g = max(sorted(set(same)), key=same.count) if same else g
        if out and out[-1][2] == g:
            n = out[-1][1] - out[-1][0]
            out[-1][3] = (out[-1][3] * n + c * (z - a)) / (n + z - a)
            out[-1][1] = z
        else:
            out.append([a, z, g, c])
    return [tuple(s) for s in out]


def heading_keys(headers: DataFrame) -> DataFrame:
    """doc_id, headers: the distinct headings of each leaflet in a form for comparison (a few for each)."""

    def key(batches):
        for b in batches:
            b["key"] = [_line_key(t) if t else "" for t in b["text"]]
            yield b[["doc_id", "key"]]

    keys = headers.filter("text is not null and doc_id is not null").select("doc_id", "text").distinct().mapInPandas(key, T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("key", T.StringType())]))
    return keys.filter("key != ''").groupBy("doc_id").agg(F.collect_set("key").alias("headers"))


def identify(regions: DataFrame, headers: DataFrame, model: Model) -> DataFrame:
    """region rows with ``segments`` (array of start, end, lang, confidence).

    regions needs doc_id and text, headers doc_id and text (the headings printed on a leaflet's pages);
    other columns pass through. Null and empty texts, and texts without a sentence, have no segments; very
    long texts are read whole.
    """

    per_doc = heading_keys(headers)

    def find(batches):
        for b in batches:
            b["segments"] = [[{"start": a, "end": z, "lang": g, "confidence": c} for a, z, g, c in segments(t, h, model)] for t, h in zip(b["text"], b["headers"])]
            yield b.drop(columns=["headers"])

    joined = regions.drop("headers", "segments").join(per_doc, "doc_id", "left")
    schema = T.StructType([f for f in joined.schema.fields if f.name != "headers"] + [T.StructField("segments", T.ArrayType(SEGMENT))])
    return joined.mapInPandas(find, schema)


def label_cases(found: DataFrame) -> DataFrame:
    """Rows whose script or lang is missing or contradicts the text, or that mix languages: region_key, lang_found, confidence."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    arabic = F.exists("langs", lambda g: g.isin(*ARABIC_SCRIPT))
    latin = F.exists("langs", lambda g: ~g.isin(*ARABIC_SCRIPT))
    right = F.when(arabic & latin, "mixed").when(arabic, "arabic").otherwise("latin")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv]), F.split(F.lower(F.trim("lang")), "[-_]")[0])
    df = found.withColumn("langs", langs).filter("size(langs) > 0").withColumn("code", code)
    script = F.lower(F.trim("script"))
    wrong = ~F.coalesce(script == right, F.lit(False)) | F.col("code").isNull() | ~F.array_contains("langs", F.col("code")) | (F.size("langs") > 1)
    parts = df.filter(wrong).select("region_key", F.explode("segments").alias("s"))
    return parts.groupBy("region_key", F.col("s.lang").alias("lang_found")).agg(F.max("s.confidence").alias("confidence"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "regions").select("region_key", "doc_id", "region_type", "script", "lang", "text")
    blocks = regions.filter("region_type = 'text_block' and text is not null").drop("region_type")
    found = identify(blocks, regions.filter("region_type = 'header'").select("doc_id", "text"), fitted(spark, sf_dir))
    return label_cases(found).select("region_key", "lang_found").distinct()
