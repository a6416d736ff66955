"""Personal details in free text, found and replaced by typed placeholders.

High-recall generators propose overlapping spans for every kind of detail; gradient-boosted trees score each
span by its format and context; thresholds calibrated on held-out spans select, and of overlapping spans the
most probable wins. There are no labelled rows: a bounded sample of documents is labelled weakly, by cue words that
stand beside a span and by agreement with spans so labelled (names made of the words of cued names, numbers of the
shape of cued numbers, strict and loose generators of one kind), so that the trees and the log odds of contexts learn
also from details without a cue.
"""

from __future__ import annotations

import collections
import math
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.llm.boost import Boosted
from foliora.llm.sieve import BITS, Sieve, sieve
from foliora.sources.tables import table

KINDS = ("email", "phone", "id_number", "address", "name")
#: Documents in the training sample (a documented bound), least and default thresholds.
TRAIN_DOCS, DEFAULT_THRESHOLD = 6000, 0.5
#: Place of the cue among the features, and number of log odds of contexts, which come first.
CUE, CONTEXTS = 25, 5
#: Longest span looked at on either side for context.
CONTEXT = 60

# Words that stand beside details of private persons, and beside other numbers and names.
CUES = {
    "phone": ["reachable on", "rang", "ring", "call", "phone", "tel", "tél", "joignable au", "erreichbar unter", "rückruf", "telefon", "teléfono", "al", "wrote", "contact", "الهاتف", "الاتصال به على", "تلفن", "ext", "au", "/"],
    "id_number": ["id", "identity", "passport no", "insurance number", "medical record", "national id", "pièce d'identité", "sécurité", "ausweisnummer", "versichertennummer", "documento de identidad", "dni", "الهوية", "شماره ملی", "جواز", "بیمه", "التأمين"],
    "name": ["reported by", "carer", "mrs", "mr", "ms", "dr", "signed", "wrote", "patient", "patiente", "signalé par", "madame", "mme", "monsieur", "gemeldet von", "frau", "herr", "señora", "señor", "notificado por", "llamar a", "المريضة", "المريض", "عن الحالة", "السيدة", "السيد", "گزارش‌دهنده", "خانم", "آقای", "بیمار"],
    "address": ["address", "lives at", "went to", "back from", "habite", "ou", "wohnhaft", "domicilio en", "والعنوان", "العنوان", "نشانی"],
}
AFTER = {"name": ["lives at", "lived at", ", reachable", "habite", ", joignable", ", erreichbar", "wohnt", "nahm", "tomó", "vive en", ", teléfono", "تناولت", "تناول جرعت", "ويمكن الاتصال", "با تلفن", "دو نوبت", ", n° de"]}
OTHER = ["lot", "article code", "authorisation", "autorisation", "autorisation n°", "authorisation no", "zulassungsnummer", "registro", "trial number", "batch number", "chargennummer", "lote", "التشغيلة", "ساخت", "doses of", "code", "expires", "numéro de lot"]
# Words for kinds of streets.
STREETS_AFTER = "lane street avenue rise close road way court drive square place terrace row gardens hill walk".split()
STREETS_BEFORE = "rue avenue impasse boulevard allée chemin quai place cours calle avda av avenida c/ plaza paseo camino شارع خیابان طريق جادة کوچه بلوار".split()

D = "[0-9٠-٩۰-۹]"
UP = "A-ZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜÝŠŽ"
LOW = "a-zß-öø-ÿšž"
TOK = rf"(?:[{UP}][{LOW}'’]+(?:-[{UP}][{LOW}'’]+)*|[{UP}]{{2,}}(?:-[{UP}]{{2,}})*)"
INI = rf"[{UP}]\."
_EMAIL = re.compile(r"[A-Za-z0-9_][\w.+-]*\s?(?:@|\(at\)|\[at\]|\(a\)|＠)\s?[A-Za-z0-9][\w-]*(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9][\w-]*)+")
_PHONE = re.compile(rf"(?<![\w.+/-])(?:\+\s?)?(?:\(?{D}{{1,5}}\)?)(?:[ ./-]{{0,2}}\(?{D}{{1,8}}\)?){{1,7}}(?:\s?(?:ext|x)\.?\s?{D}{{1,5}})?(?![\w-])")
_ID = re.compile(rf"(?<![\w.+/-])(?:[A-Z]{{1,4}}[-. ]?)?{D}+(?:[-. ]{D}+)*(?:[-. ]?[A-Z]{D}?)?(?![\w@-])")
_NAMES = [re.compile(rf"{p}(?![\w'’-])") for p in (rf"{TOK} {TOK}", rf"{TOK} {INI} ?{TOK}", rf"{INI} ?(?:{INI} ?)?{TOK}", rf"{TOK}, {TOK}(?: {INI})?", rf"{TOK}, {INI}(?: ?{INI})?", rf"{TOK} {TOK} {TOK}")]
_NAME_START = re.compile(rf"(?<![\w-])[{UP}][\w'’-]*\.?,? ?(?=[{UP}])")
_ARABIC_WORD = "[ء-يٱ-ۓ‌]+"
_ARABIC_NAME = re.compile(rf"(?<![\w‌])(?=(?P<n>{_ARABIC_WORD} {_ARABIC_WORD})(?![\w‌]))")
_ARABIC_CUE = re.compile(rf"(?:{'|'.join(w for w in CUES['name'] if not w.isascii() and w[-1] > 'ء')})[ :]*$")
_ARABIC_AFTER = re.compile(rf" ?(?:{'|'.join(w for w in AFTER['name'] if w[-1] > 'ء')})")
_HOUSE = rf"{D}{{1,4}}(?: ?[a-d](?![\w])| ?bis| ?ter)?"
_ADDRESS = [
    re.compile(rf"(?<![\w.-]){_HOUSE},? (?:[{UP}][\w'’-]+ ){{1,3}}(?:{'|'.join(s.capitalize() for s in STREETS_AFTER)}|{'|'.join(s.upper() for s in STREETS_AFTER)})\b"),
    re.compile(rf"(?<![\w.-]){_HOUSE},? (?:{'|'.join(STREETS_BEFORE[:9])})\b (?:(?:de la|de l'|des|du|de|d')\s?)?[{UP}][\w'’-]+", re.I),
    re.compile(rf"(?<![\w.-])(?:calle|avda\.?|avenida|av\.|c/|plaza|paseo|camino|c\.) ?(?:(?:de la|de los|del|de) )?[{UP}][\w'’-]+,? ?(?:n\.º ?|nº ?|núm\. ?)?{D}{{1,4}}[a-d]?", re.I),
    re.compile(rf"(?<![\w.-])(?:Am |An der |Im |Auf der )?[{UP}][\w-]*(?:str\.|straße|strasse|weg|gasse|platz|allee|hof|ring|damm|ufer)\s{D}{{1,4}}[a-d]?(?![\w])"),
    re.compile(rf"(?<![\w])(?:شارع|خیابان|طريق|جادة|کوچه|بلوار) (?:{_ARABIC_WORD} ){{1,3}}(?:(?:رقم|پلاک|شماره) )?{D}{{1,4}}"),
]


_AT = re.compile(r"@|＠|\((?:at|a)\)|\[at\]")
#: Looser generators: anything about a sign of address, and a house number with any capitalised words.
_LOOSE_EMAIL = re.compile(r"[^\s@＠,;<>]+\s?(?:@|\(at\)|\[at\]|\(a\)|＠)\s?[^\s@＠,;<>]*[^\s@＠,;<>.]")
_LOOSE_ADDRESS = re.compile(rf"(?<![\w.,/-]){_HOUSE},? [{UP}][{LOW}'’-]+(?: [{UP}][{LOW}'’-]+){{1,2}}(?![\w-])")
_ID_MIXED = re.compile(rf"(?<![\w.+/-])[A-Z]{{1,4}}{D}{{5,}}[A-Z]{{1,2}}{D}{{1,2}}(?![\w-])")
_HAS_ARABIC = re.compile("[ء-ۓ]")
#: Quick tests that no span of a kind fails: six digits near each other, a house number before a word, parts of names of streets.
_DENSE = re.compile(rf"{D}(?:[-. /()+A-Z]{{0,4}}{D}){{5}}")
_HOUSE_START = re.compile(rf"(?<![\w.-])(?={_HOUSE},? [^\W\d_])")
_BY_HOUSE = (_ADDRESS[0], _ADDRESS[1], _LOOSE_ADDRESS)
_BY_STREET = (
    (_ADDRESS[2], ("calle", "avda", "avenida", "av.", "c/", "plaza", "paseo", "camino", "c.")),
    (_ADDRESS[3], ("str.", "straße", "strasse", "weg", "gasse", "platz", "allee", "hof", "ring", "damm", "ufer")),
    (_ADDRESS[4], tuple(STREETS_BEFORE[-6:])),
)


def arabic_pairs(text: str):
    """(start, end, first, second word, whether a cue stands before) of every pair of words in Arabic script."""
    for m in _ARABIC_NAME.finditer(text):
        a, z = m.span("n")
        first, second = m["n"].split(" ", 1)
        yield a, z, first, second, bool(_ARABIC_CUE.search(text, max(0, a - 16), a))


def candidates(text: str, known=None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span that may be a detail; spans overlap.

    Arabic script has no capitals: a pair of words may be a name if a cue stands before it or either word is known
    from cued names (``known``, a test of a word and its place 1 or 2).
    """
    out = []
    if _AT.search(text):
        out += [("email", *m.span()) for r in (_EMAIL, _LOOSE_EMAIL) for m in r.finditer(text)]
    if _DENSE.search(text):
        for m in _PHONE.finditer(text):
            s = m[0].rstrip(" ./-")
            if len(s) >= 7:
                n = sum(map(str.isdigit, re.sub(r"(?:ext|x)\.?\s?\S+$", "", s) if "x" in s else s))
                if 7 <= n <= 16:
                    out.append(("phone", m.start(), m.start() + len(s)))
        for m in _ID.finditer(text):
            s = m[0]
            if len(s) >= 8 and sum(map(str.isdigit, s)) >= 6 and sum(map(str.isalnum, s)) >= 8:
                out.append(("id_number", *m.span()))
        out += [("id_number", *m.span()) for m in _ID_MIXED.finditer(text)]
    arabic = not text.isascii() and bool(_HAS_ARABIC.search(text))
    for m in _HOUSE_START.finditer(text):
        out += [("address", m.start(), n.end()) for r in _BY_HOUSE if (n := r.match(text, m.start()))]
    low = text.lower()
    for r, signs in _BY_STREET:
        if any(w in low for w in signs):
            out += [("address", *m.span()) for m in r.finditer(text)]
    for m in _NAME_START.finditer(text):
        out += [("name", m.start(), n.end()) for r in _NAMES if (n := r.match(text, m.start()))]
    if arabic:
        for a, z, first, second, cued in arabic_pairs(text):
            if cued or (known is not None and (known(first, 1) or known(second, 2))):
                out.append(("name", a, z))
    return sorted(set(out), key=lambda c: (c[1], -c[2], c[0]))


def shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s))


_W = re.compile(r"[^\W\d_][\w'’‌]*|[^\w\s]", re.U)


def beside(text: str, a: int, z: int) -> tuple[list[str], list[str], str, str]:
    """Words just before and after a span, in small letters, and the texts they come from."""
    left, right = text[max(0, a - CONTEXT) : a].casefold(), text[z : z + CONTEXT].casefold()
    cut = max(left.rfind(". "), left.rfind("\n"))
    last = left[cut + 1 :] if cut >= 0 and cut < len(left) - 4 and not re.search(r"\b(?:dr|mr|mrs|no|tél|mme|tel|ext)\. ?$", left[: cut + 2]) else left
    nl = right.find("\n")
    first = right if nl < 0 else right[:nl]
    return _W.findall(last)[-4:], _W.findall(first)[:3], last.rstrip(), first.lstrip(" ")


def context_keys(kind: str, left: list[str], right: list[str]) -> list[str]:
    return [f"{kind}<{' '.join(left[-2:])}", f"{kind}<{' '.join(left[-1:])}", f"{kind}<<{' '.join(left[-3:])}", f"{kind}>{' '.join(right[:1])}", f"{kind}>>{' '.join(right[:2])}"]


def cue(kind: str, last: str, first: str) -> int:
    """1 where a cue word stands beside the span, -1 where one of something else does, 0 otherwise."""
    tail = last.rstrip(" :.,;#").rstrip()
    if any(tail.endswith(w) and not tail[: -len(w)][-1:].isalpha() for w in OTHER):
        return -1
    if any(tail.endswith(w) and (not tail[: -len(w)][-1:].isalpha() or w == "/") for w in CUES.get(kind, ())):
        return 1
    if any(first.startswith(w) for w in AFTER.get(kind, ())):
        return 1
    return 0


def name_words(s: str) -> list[str]:
    return re.findall(r"[^\W\d_]{2,}", s.casefold())


def word_place(word: str, place: int) -> int:
    return zlib.crc32(f"{place}{word}".encode()) % BITS


_GOES_ON = re.compile(r"[,;:]?\s*[a-z]")
NUMBERS = ("phone", "id_number")


TITLES = set("dr mrs mr ms frau herr madame mme monsieur señora señor".split())
#: Least cued uses of a name word or shape, and least share of cued uses among all, for spans without a cue to be labelled like them.
LEAST_AGREE, AGREE = 3, 0.5
#: Probabilities of the first fit from which a name without a cue counts as one in the second, or stays open.
SURE, OPEN = 0.5, 0.1


class Finder:
    """Log odds of contexts, formats and name words, and the trees with their thresholds, by kind."""

    def __init__(self) -> None:
        self.odds: dict[str, float] = {}
        self.models: dict[str, tuple[Boosted, float]] = {}
        self.known: frozenset[tuple[str, int]] = frozenset()
        self.cued: Sieve | None = None

    def knows(self, word: str, place: int) -> bool:
        """Whether the word is the first (1) or second (2) of cued names, in the sample or (with ``cued``) in all documents."""
        return (word, place) in self.known or (self.cued is not None and self.cued.has(word_place(word, place)))

    def features(self, text: str, kind: str, a: int, z: int) -> list[float]:
        s = text[a:z]
        left, right, last, first = beside(text, a, z)
        get = self.odds.get
        ctx = [get(k, 0.0) for k in context_keys(kind, left, right)]
        groups = [len(g) for g in re.findall(rf"{D}+", s)]
        words = name_words(s)
        odds = [get(f"{kind}={w}", self.unseen) for w in words] if kind == "name" else [0.0]
        return [
            *ctx, get(f"{kind}~{shape(s)}", 0.0), len(s), sum(groups), len(groups), max(groups, default=0), s[:1] == "+", "(" in s, s[:2] in ("00", "٠٠", "۰۰"),
            sum(map(str.isalpha, s)), "ext" in s, s.count("-"), s.count("."), s.count(" "), "/" in s, "," in s, s.isupper(), len(words), min(odds, default=0.0), max(odds, default=0.0), sum(odds) / max(1, len(odds)),
            cue(kind, last, first), not last.strip(), bool(_GOES_ON.match(first)),
        ]

    #: Log odds of a name word that the sample does not hold.
    unseen = -1.0

    def fit(self, texts: list[str]) -> "Finder":
        cued = collections.Counter((w, k) for t in texts if _HAS_ARABIC.search(t) for _, _, x, y, c in arabic_pairs(t) if c for w, k in ((x, 1), (y, 2)))
        self.known = frozenset(w for w, n in cued.items() if n >= LEAST_AGREE)

        def or_some(word: str, place: int) -> bool:  # and one pair in 16, by its first word, as counter-examples
            return (word, place) in self.known or (place == 1 and zlib.crc32(word.encode()) % 16 == 0)

        rows = []
        for k, t in enumerate(texts):
            for kind, a, z in candidates(t, or_some):
                left, right, last, first = beside(t, a, z)
                rows.append((k, kind, a, z, left, right, cue(kind, last, first), kind in NUMBERS and any(cue(o, last, first) > 0 for o in NUMBERS if o != kind)))
        told = self._labels(texts, rows)
        self._learn(texts, rows, told, ("name",))
        # once more, with names without a cue labelled by what was learned: their contexts become known, too
        loose = [i for i, r in enumerate(rows) if r[1] == "name" and r[6] == 0]
        if loose and "name" in self.models:
            p = self.models["name"][0].predict(np.array([self.features(texts[rows[i][0]], *rows[i][1:4]) for i in loose]))
            for i, q in zip(loose, p):
                if q >= SURE:
                    told[i] = 1
                elif told[i] == 0 and q >= OPEN:
                    told[i] = None
        self._learn(texts, rows, told)
        return self

    def _learn(self, texts: list[str], rows: list[tuple], told: list[int | None], kinds: tuple[str, ...] = KINDS) -> None:
        """Log odds, trees and thresholds from the labelled rows."""
        self.odds = {}
        rows, y = [r for r, v in zip(rows, told) if v is not None], [v for v in told if v is not None]
        good, bad, total = collections.Counter(), collections.Counter(), collections.Counter()
        for (k, kind, a, z, left, right, *_), v in zip(rows, y):
            s = texts[k][a:z]
            total[kind, v] += 1
            keys = {*context_keys(kind, left, right), f"{kind}~{shape(s)}", *((f"{kind}={w}" for w in name_words(s)) if kind == "name" else ())}
            (good if v else bad).update(keys)
        for k in good.keys() | bad.keys():
            if good[k] + bad[k] >= 3:
                kind = re.split(r"[<>~=]", k)[0]
                self.odds[k] = math.log((good[k] + 0.5) / (total[kind, 1] + 1)) - math.log((bad[k] + 0.5) / (total[kind, 0] + 1))
        for kind in kinds:
            mine = [i for i, r in enumerate(rows) if r[1] == kind]
            if not mine:
                continue
            v = np.array([y[i] for i in mine], float)
            x = np.array([self.features(texts[rows[i][0]], *rows[i][1:4]) for i in mine])
            blind = x.copy()
            blind[:, CUE] = 0  # each span also without its cue, and without what is known of its context, so that format and words must serve
            bare = blind.copy()
            bare[:, :CONTEXTS] = 0
            if len(set(v)) < 2:
                self.models[kind] = (Boosted(trees=0).fit(np.zeros((2, x.shape[1])), np.array([v[0], v[0]])), DEFAULT_THRESHOLD)
                continue
            fold = np.arange(len(v)) % 4 == 3
            model = Boosted(trees=50).fit(np.concatenate([x[~fold], blind[~fold], bare[~fold]]), np.concatenate([v[~fold]] * 3))
            p = model.predict(x[fold])
            best = (-1.0, DEFAULT_THRESHOLD)
            for t in np.linspace(0.2, 0.8, 13):
                got = p >= t
                f1 = 2 * (got & (v[fold] > 0)).sum() / max(1, got.sum() + v[fold].sum())
                if f1 > best[0] or (f1 == best[0] and abs(t - 0.5) < abs(best[1] - 0.5)):
                    best = (float(f1), float(t))
            self.models[kind] = (model, best[1])

    def _labels(self, texts: list[str], rows: list[tuple]) -> list[int | None]:
        """1, 0, or None where cues and agreement leave a span open; rows: text, kind, start, end, words before and after, own cue, cue of another kind of number."""
        words, shapes = collections.Counter(), collections.Counter()
        cued_names: dict[int, list[tuple[int, int]]] = collections.defaultdict(list)
        for k, kind, a, z, _, _, c, _ in rows:
            if kind == "name" and c > 0 and not TITLES & set(name_words(texts[k][a:z])):
                cued_names[k].append((a, z))

        def within(k: int, a: int, z: int) -> bool:
            return any(x <= a and z <= y and (x, y) != (a, z) for x, y in cued_names.get(k, ()))

        for k, kind, a, z, _, _, c, other in rows:
            s = texts[k][a:z]
            if kind == "name" and (c > 0 or not within(k, a, z)):
                words.update((w, c > 0) for w in set(name_words(s)))
            elif kind in NUMBERS and (c or other):
                shapes[kind, shape(s), c > 0] += 1

        def agree(yes: int, no: int) -> bool:
            return yes >= LEAST_AGREE and yes >= AGREE * (yes + no)

        out: list[int | None] = []
        for k, kind, a, z, _, _, c, other in rows:
            s = texts[k][a:z]
            if kind == "email":
                out.append(int(bool(_EMAIL.fullmatch(s))))
            elif kind == "address":
                strict = any(r.fullmatch(s) for r in _ADDRESS)
                out.append(int(c >= 0) if strict else int(c > 0))
            elif kind == "name":
                own = name_words(s)
                if TITLES & set(own) or not own:
                    out.append(0)
                elif c > 0:
                    out.append(1)
                elif within(k, a, z):
                    out.append(0)
                else:  # all of its words are those of cued names, or some, or none
                    known = [agree(words[w, True], words[w, False]) for w in own]
                    out.append(1 if all(known) else None if any(known) else 0)
            elif c > 0:
                out.append(1)
            elif c < 0 or other:
                out.append(0)
            elif kind == "phone" and re.match(rf"\+|\({D}|00", unicodedata.normalize("NFKC", s)):
                out.append(1)
            else:
                yes, no = shapes[kind, shape(s), True], shapes[kind, shape(s), False]
                out.append(1 if agree(yes, no) else 0 if agree(no, yes) else None)
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Chosen spans of each text: (kind, start, end, probability), in order, without overlaps."""
        per: dict[str, list] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            for kind, a, z in candidates(t, self.knows) if t else ():
                per[kind].append((i, a, z))
        scored: list[list] = [[] for _ in texts]
        for kind, spans in per.items():
            if not spans or kind not in self.models:
                continue
            model, least = self.models[kind]
            for at in range(0, len(spans), 20_000):
                part = spans[at : at + 20_000]
                p = model.predict(np.array([self.features(texts[i], kind, a, z) for i, a, z in part]))
                for (i, a, z), q in zip(part, p):
                    if q >= least:
                        scored[i].append((kind, a, z, float(q)))
        out = []
        for spans in scored:
            chosen: list = []
            for s in sorted(spans, key=lambda s: (-round(s[3], 2), s[1] - s[2], s[1], s[0])):
                if all(s[2] <= a or z <= s[1] for _, a, z, _ in chosen):
                    chosen.append(s)
            out.append(sorted(chosen, key=lambda s: s[1]))
        return out


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in brackets."""
    parts, at = [], 0
    for kind, a, z, _ in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join(parts) + text[at:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("p", T.DoubleType())])


#: Least distinct texts in which a word of a name in Arabic script stands beside a cue.
LEAST_CUED = 3


def cued_words(documents: DataFrame) -> DataFrame:
    """word, place: first (1) and second (2) words of the pairs in Arabic script that stand beside a cue of a name in LEAST_CUED distinct texts or more, over all documents. Texts are not shuffled, only these words with their text's hash."""

    def find(batches):
        for b in batches:
            out = set()
            for t in b["text"]:
                h = zlib.crc32(t.encode()) << 31 | zlib.adler32(t.encode()) >> 1
                for a, z, first, second, cued in arabic_pairs(t):
                    if cued or _ARABIC_AFTER.match(t, z):
                        _, _, last, then = beside(t, a, z)
                        if cue("name", last, then) > 0:
                            out |= {(first, 1, h), (second, 2, h)}
            yield pd.DataFrame(sorted(out), columns=["word", "place", "h"])

    found = documents.select("text").filter(F.col("text").rlike("[ء-ۓ]")).mapInPandas(find, "word string, place int, h bigint")
    return found.distinct().groupBy("word", "place").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_CUED).select("word", "place")


def training_texts(documents: DataFrame, most: int) -> list[str]:
    """At most ``most`` distinct whole texts, those of smallest hash among documents that may hold a detail. Hashes are made distinct first, so that copies neither travel nor crowd out others."""
    marks = r"[@+]|\d{4}|\[at\]|\(at\)|\p{N}{3}[ .-]\p{N}{3}|Dr\.|Mrs|Mr\.|Frau|señor|Patient|par |المريض|الحالة|خانم|گزارش"
    marked = documents.select("text").filter(F.col("text").rlike(marks)).withColumn("h", F.xxhash64("text"))
    hashes = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(most).collect()]
    if not hashes:
        return []
    return [r["text"] for r in marked.filter(F.col("h") <= hashes[-1]).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text").collect()]


def fitted(documents: DataFrame, most: int = TRAIN_DOCS) -> Finder:
    """Trees trained on at most ``most`` distinct texts; words of names in Arabic script come from all documents, as a set of fixed size."""
    finder = Finder().fit(training_texts(documents, most))
    words = cued_words(documents)
    finder.cued = sieve(words, F.crc32(F.concat(F.col("place").cast("string"), F.col("word")).cast("binary")))
    return finder


def redactions(documents: DataFrame, finder: Finder) -> DataFrame:
    """The rows with ``spans`` (array of kind, start_pos, end_pos, p) and ``redacted``.

    documents needs a column text; other columns pass through. Null texts stay null with no spans, empty
    texts stay empty; very long texts are read whole; of equally probable overlapping spans the longer, then
    the earlier one counts.
    """
    schema = T.StructType([*[f for f in documents.schema.fields if f.name not in ("spans", "redacted")], T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])

    def apply(batches):
        for b in batches:
            found = finder.find(list(b["text"]))
            b["spans"] = [[dict(zip(SPAN.names, s)) for s in spans] for spans in found]
            b["redacted"] = [redact(t, s) if t else t for t, s in zip(b["text"], found)]
            yield b

    return documents.drop("spans", "redacted").mapInPandas(apply, schema)


def p9_found(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = redactions(docs, fitted(docs))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.start_pos").distinct()
