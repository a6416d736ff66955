"""Sentences of two language versions of a text paired with their translations.

Shared numbers, codes, names (by transcription) and cognates are anchors. A first pass over the corpus pairs
sentences by anchors alone and counts which words of the two languages meet in such pairs, which gives a lexicon. The
second finds the best partner of every clause through inverted lists, chains the sure pairs by a longest increasing
subsequence, and aligns the gaps between neighbours on the chain by dynamic programming over the pairs that can count,
with omissions and merges. Sure pairs off the chain are kept as reordered ones. No pair is left out: lists are read from
the rarest member on only until what is left of a clause can change nothing, and a clause that would need a long list
is compared with the whole other side at once, in arrays.
"""

from __future__ import annotations

import collections
import math
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.llm.langid import skeleton
from foliora.llm.names import fold, transcribe
from foliora.session import cut_lineage
from foliora.sources.tables import once, table

#: Least meetings and association of a lexicon entry, most entries held by every task (a larger lexicon is joined to each text's words instead), least scores.
LEAST_MEETINGS, LEAST_DICE, MOST_ENTRIES = 4, 0.15, 400_000
#: Longest list that is read entry by entry; a clause that needs a longer one is compared with all of the other side in arrays, with the same result.
SHORT = 64
#: Slack of bounds on sums of shares, for their rounding; digits of scores, so that the order of a sum makes no difference between partners.
SLACK, DIGITS = 1e-9, 12
SURE, CONTAINED, GAP = 0.72, 0.72, 0.5
ANCHOR_WEIGHT = 3.0

_SPLIT = re.compile(r"(?<=[.!?؟])\s+")
_JOIN = re.compile(r",\s+(?:and|und|et|y)\s+|،\s*(?:كما\s+أنه\s+|و\s*)")
_ASIDE = re.compile(r"\([^()]*\)")
_PART = re.compile(r"[A-Za-z]*[0-9٠-٩۰-۹][0-9٠-٩۰-۹A-Za-z.,٫٬]*|[^\W\d_]+", re.U)


def sentences(text: str | None) -> list[str]:
    """Numbered as they stand: a sentence ends at . ! ? or ؟ followed by white space or the end."""
    if not text or not text.strip():
        return []
    return [s for s in _SPLIT.split(text.strip()) if s.strip()]


@lru_cache(maxsize=100_000)
def _number(s: str) -> str:
    out = "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c for c in s).replace("٫", ".").replace("٬", "")
    return re.sub(r",(?=[0-9]{3}(?![0-9]))", "", out).strip(".,").upper()


@lru_cache(maxsize=200_000)
def _sound(word: str) -> str:
    """A name in Arabic letters, whatever script it is printed in."""
    return fold(transcribe(skeleton(word)))


@lru_cache(maxsize=300_000)
def _read(part: str) -> tuple[str | None, str | None, bool]:
    """Number, or word (of two letters or more) and whether it is long enough for a name."""
    if any(c.isdigit() for c in part):
        return _number(part), None, False
    return None, skeleton(part) if len(part) > 1 else None, len(part) >= 6


def near(a: str, b: str) -> bool:
    """Equal or one edit apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return (a[i + 1 :] == b[i:]) if len(a) > len(b) else (a[i:] == b[i + 1 :])


def clauses(sentence: str) -> list[str]:
    """The parts that a sentence joins by a comma and a conjunction; each of three words or more."""
    parts = _JOIN.split(sentence)
    return parts if all(len(p.split()) >= 3 for p in parts) else [sentence]


class Side:
    """Numbers, sounds of possible names and words of every clause of one side; owner: its sentence."""

    def __init__(self, text: str | None) -> None:
        whole = sentences(text)
        self.sentences, self.owner = [], []
        for k, s in enumerate(whole):
            for c in clauses(s):
                self.sentences.append(c)
                self.owner.append(k)
        self.numbers, self.words, self.latin = [], [], []
        for s in self.sentences:
            numbers, words, latin = set(), set(), set()
            for number, word, long in map(_read, _PART.findall(_ASIDE.sub(" ", s))):
                if number is not None:
                    numbers.add(number)
                elif word is not None:
                    words.add(word)
                    if long:
                        latin.add(word)
            self.numbers.append(numbers)
            self.words.append(words)
            self.latin.append(latin)

    def __len__(self) -> int:
        return len(self.sentences)


def shared_names(en: Side, ar: Side) -> dict[str, set[str]]:
    """English words that also stand on the Arabic side, by sound (one edit apart, in long ones) or as they are: word to the Arabic words it equals."""
    sounds = collections.defaultdict(set)
    for w in set().union(*ar.words) if len(ar) else ():
        if len(w) >= 5:
            sounds[_sound(w)].add(w)
    # one edit leaves the first three letters or the last three of six or more as they are
    ends: dict[str, list[str]] = collections.defaultdict(list)
    for s in sounds:
        if len(s) >= 6:
            ends[s[:3] + "-"].append(s)
            ends["-" + s[-3:]].append(s)
    out = {}
    for w in set().union(*en.latin) if len(en) else ():
        t = _sound(w)
        hits = sounds.get(t)
        if not hits and len(t) >= 7:
            hits = set().union(*[sounds[s] for s in {*ends.get(t[:3] + "-", ()), *ends.get("-" + t[-3:], ())} if s[0] == t[0] and near(s, t)] or [set()])
        if hits:
            out[w] = set(hits)
    return out


def anchors(en: Side, ar: Side) -> tuple[list[set], list[set], dict[str, set[str]]]:
    """Numbers, codes and names of each sentence of both sides, in one spelling."""
    names = shared_names(en, ar)
    back = {a: w for w, many in sorted(names.items()) for a in many}
    e = [n | {w for w in words if w in names} for n, words in zip(en.numbers, en.latin)]
    a = [n | {back[w] for w in words if w in back} for n, words in zip(ar.numbers, ar.words)]
    return e, a, names


def postings(sets: list[set]) -> dict[str, list[int]]:
    """Where each member stands."""
    out: dict[str, list[int]] = {}
    for i, own in enumerate(sets):
        for k in own:
            out.setdefault(k, []).append(i)
    return out


class Inverted:
    """How much of every clause of one side is contained in those of the other; a member (word or anchor) of a clause has the list of the others' clauses with how much of it they contain."""

    def __init__(self, members: list, into: dict[object, dict[int, float]], weight: list[float], size: int) -> None:
        self.into, self.weight, self.size = into, weight, size
        self.most = {k: max(row.values()) for k, row in into.items()}
        cost = {k: len(row) / self.most[k] for k, row in into.items()}
        self.own = [sorted((k for k in ks if k in into), key=cost.__getitem__) for ks in members]
        self._arrays: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        self._back: list[list[tuple[object, float]]] | None = None

    def share(self, i: int, j: int) -> float:
        """The share of clause i that the other side's clause j contains."""
        return sum(self.into[k].get(j, 0.0) for k in self.own[i]) / self.weight[i] if self.own[i] else 0.0

    def shares(self, i: int) -> np.ndarray:
        """The shares of clause i that each of the other side's clauses contains."""
        out = np.zeros(self.size)
        for k in self.own[i]:
            got = self._arrays.get(k)
            if got is None:
                row = self.into[k]
                got = self._arrays[k] = np.fromiter(row, np.int64, len(row)), np.fromiter(row.values(), float, len(row))
            out[got[0]] += got[1]
        return out / self.weight[i] if self.own[i] else out

    def shares_by(self, j: int) -> np.ndarray:
        """The shares of all clauses that the other side's clause j contains."""
        if self._back is None:
            self._back = [[] for _ in range(self.size)]
            for k, row in self.into.items():
                for h, d in row.items():
                    self._back[h].append((k, d))
            self._places = {k: np.array(v) for k, v in postings(self.own).items()}
            self._weights = np.array([w or 1.0 for w in self.weight])
        out = np.zeros(len(self.own))
        for k, d in self._back[j]:
            if k in self._places:
                out[self._places[k]] += d
        return out / self._weights

    def lists(self, i: int):
        """The lists of clause i, shortest for their weight first, each with the greatest share that a clause in none before it can contain."""
        left = sum(self.most[k] for k in self.own[i])
        for k in self.own[i]:
            yield left / self.weight[i], self.into[k]
            left = max(0.0, left - self.most[k])

    def reach(self, i: int, least: float) -> dict[int, float]:
        """Every clause of the other side that contains at least such a share of clause i, with the share."""
        some: set[int] = set()
        for bound, row in self.lists(i):
            if bound < least - SLACK:
                break
            if len(row) > SHORT:
                every = self.shares(i)
                js = np.flatnonzero(every >= least - SLACK)
                return dict(zip(js.tolist(), every[js].tolist()))
            some.update(row)
        return {j: x for j in some if (x := self.share(i, j)) >= least - SLACK}


#: Least score of an anchor pair; a partner within RIVAL of it makes it doubtful.
ANCHORED, RIVAL = 0.9, 0.1


def by_anchors(e: list[set], a: list[set]) -> list[tuple[int, int]]:
    """Pairs that are each other's only best by anchors alone, with nearly all anchors shared; one anchor serves if no other sentence has it."""
    pe, pa = postings(e), postings(a)
    df = {k: len(pe.get(k, ())) + len(pa.get(k, ())) for k in pe.keys() | pa.keys()}
    weight = {k: 1 / n for k, n in df.items()}
    te, ta = [sum(weight[k] for k in s) for s in e], [sum(weight[k] for k in s) for s in a]
    both = pe.keys() & pa.keys()
    of_e = Inverted(e, {k: dict.fromkeys(pa[k], weight[k]) for k in both}, te, len(a))
    of_a = Inverted(a, {k: dict.fromkeys(pe[k], weight[k]) for k in both}, ta, len(e))
    # a score 2 w / (te + ta) of s needs w >= s / (2 - s) of either side, because w is in both
    least = ANCHORED - RIVAL
    least /= 2 - least

    def score(i: int, j: int) -> float:
        return 2 * sum(weight[k] for k in e[i] & a[j]) / (te[i] + ta[j])

    times = collections.Counter(map(frozenset, e))
    out = []
    for i, own in enumerate(e):
        # sentences with the same anchors are rivals for each partner
        if not own or times[frozenset(own)] > 1 or (len(own) < 2 and not all(df[k] == 2 for k in own)):
            continue
        row = [(score(i, j), -j) for j in of_e.reach(i, least)]
        v, j = max(row, default=(0.0, 0))
        if v >= ANCHORED and sum(x >= v - RIVAL for x, _ in row) == 1 and sum(score(h, -j) >= v - RIVAL for h in of_a.reach(-j, least)) == 1:
            out.append((i, -j))
    return out


MEETING = T.StructType([T.StructField("en", T.StringType()), T.StructField("ar", T.StringType()), T.StructField("n", T.LongType())])


class Lexicon:
    """English words to their Arabic ones with an association from 0 to 1, and the best association of each word of both."""

    def __init__(self, entries=()) -> None:
        self.to: dict[str, dict[str, float]] = {}
        self.best_en: dict[str, float] = {}
        self.best_ar: dict[str, float] = {}
        for w, v, d in entries:
            self.to.setdefault(w, {})[v] = d
            self.best_en[w] = max(d, self.best_en.get(w, 0.0))
            self.best_ar[v] = max(d, self.best_ar.get(v, 0.0))


def lexicon(texts: DataFrame) -> DataFrame:
    """en, ar, dice: words of the two languages with their association, from all anchor pairs of the corpus."""

    def meet(batches):
        for b in batches:
            seen: collections.Counter = collections.Counter()
            for x, y in zip(b["en"], b["ar"]):
                en, ar = Side(x), Side(y)
                e, a, names = anchors(en, ar)
                arabic = set().union(*names.values()) if names else set()
                for i, j in by_anchors(e, a):
                    we, wa = en.words[i] - names.keys(), ar.words[j] - arabic
                    seen.update([(w, "") for w in we])
                    seen.update([("", v) for v in wa])
                    seen.update([(w, v) for w in we for v in wa])
            yield pd.DataFrame([(w, v, n) for (w, v), n in seen.items()], columns=MEETING.names)

    counts = texts.select("en", "ar").mapInPandas(meet, MEETING).groupBy("en", "ar").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.filter(F.col("n") >= LEAST_MEETINGS))
    pairs = counts.filter("en != '' and ar != ''")
    scored = pairs.join(counts.filter("ar = ''").select("en", F.col("n").alias("ne")), "en").join(counts.filter("en = ''").select("ar", F.col("n").alias("na")), "ar")
    return cut_lineage(scored.withColumn("dice", 2 * F.col("n") / (F.col("ne") + F.col("na"))).filter(F.col("dice") >= LEAST_DICE).select("en", "ar", "dice"))


#: Weight of a word that the lexicon lacks.
UNKNOWN = 0.3


class Scores:
    """How much of a clause of either side is contained in one of the other, and the best partner of every clause that has a sure one."""

    def __init__(self, en: Side, ar: Side, lex: Lexicon) -> None:
        e, a, names = anchors(en, ar)
        arabic = set().union(*names.values()) if names else set()
        we, wa = [w - names.keys() for w in en.words], [w - arabic for w in ar.words]
        be, ba = lex.best_en, lex.best_ar
        te = [sum(be.get(w, UNKNOWN) for w in ws) + ANCHOR_WEIGHT * len(k) for ws, k in zip(we, e)]
        ta = [sum(ba.get(v, UNKNOWN) for v in ws) + ANCHOR_WEIGHT * len(k) for ws, k in zip(wa, a)]
        # the other side's words count whether or not they are names there
        pe, pa, qe, qa = set().union(*we), set().union(*wa), postings(en.words), postings(ar.words)
        into_e: dict[object, dict[int, float]] = {}
        into_a: dict[object, dict[int, float]] = {}
        for w in qe:
            for v, d in lex.to.get(w, {}).items():
                if v in qa:
                    if w in pe:
                        row = into_e.setdefault(w, {})
                        for j in qa[v]:
                            if d > row.get(j, 0.0):
                                row[j] = d
                    if v in pa:
                        row = into_a.setdefault(v, {})
                        for i in qe[w]:
                            if d > row.get(i, 0.0):
                                row[i] = d
        # an anchor is a member of its own, apart from a word of the same letters
        ke, ka = postings(e), postings(a)
        for k in ke.keys() & ka.keys():
            into_e[k,] = dict.fromkeys(ka[k], ANCHOR_WEIGHT)
            into_a[k,] = dict.fromkeys(ke[k], ANCHOR_WEIGHT)
        self.n, self.m = len(en), len(ar)
        self.e = Inverted([[*ws, *((k,) for k in ks)] for ws, ks in zip(we, e)], into_e, te, self.m)
        self.a = Inverted([[*ws, *((k,) for k in ks)] for ws, ks in zip(wa, a)], into_a, ta, self.n)
        self.known: dict[tuple[int, int], float] = {}
        self.best_e = [self._best(i, self.e, self.a, False) for i in range(self.n)]
        self.best_a = [self._best(j, self.a, self.e, True) for j in range(self.m)]

    def off(self, i, j):
        """How far a pair is from the diagonal; of equally good partners the nearer one counts."""
        return 1e-3 * abs(i * (self.m / self.n) - j) / max(self.n, self.m)

    def both(self, i: int, j: int) -> float:
        got = self.known.get((i, j))
        if got is None:
            got = self.known[i, j] = round(math.sqrt(self.e.share(i, j) * self.a.share(j, i)), DIGITS)
        return got

    def row(self, i: int, ja: list[int], js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of clause i contained in those of ja, and of those in i."""
        if len(ja) * 4 <= SHORT:
            return np.array([self.e.share(i, j) for j in ja]), np.array([self.a.share(j, i) for j in ja])
        return self.e.shares(i)[js], self.a.shares_by(i)[js]

    def _best(self, i: int, own: Inverted, other: Inverted, turned: bool) -> int | None:
        """The best partner of a clause, if it has one with a score of SURE."""
        top, at, seen = SURE - 2e-3, None, set()
        for bound, row in own.lists(i):
            # no share is above 1
            if math.sqrt(bound) < top - SLACK:
                break
            if len(row) > SHORT:
                js = np.arange(own.size)
                every = np.sqrt(own.shares(i) * other.shares_by(i)).round(DIGITS) - (self.off(js, i) if turned else self.off(i, js))
                at = int(every.argmax())
                break
            for j in row.keys() - seen:
                seen.add(j)
                s = self.both(j, i) - self.off(j, i) if turned else self.both(i, j) - self.off(i, j)
                if s > top or (s == top and at is not None and j < at):
                    top, at = s, j
        return at if at is not None and (self.both(at, i) if turned else self.both(i, at)) >= SURE else None


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, ordered by the first, in which the second grows."""
    tails: list[int] = []
    at: list[int] = []
    prev: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        prev.append(at[p - 1] if p else -1)
    chain = []
    k = at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = prev[k]
    return chain[::-1]


def align(en_text: str | None, ar_text: str | None, lex: Lexicon) -> list[tuple[int, int]]:
    """Pairs of sentence numbers (from 1) with the same content."""
    en, ar = Side(en_text), Side(ar_text)
    n, m = len(en), len(ar)
    if not n or not m:
        return []
    scores = Scores(en, ar, lex)
    # sure pairs: each the other's best
    sure = [(i, j) for i, j in enumerate(scores.best_e) if j is not None and scores.best_a[j] == i]
    chain = increasing(sure)
    pairs = set(chain)
    edges = [(-1, -1), *chain, (n, m)]
    used_e, used_a = {i for i, _ in sure}, {j for _, j in sure}
    for (i0, j0), (i1, j1) in zip(edges, edges[1:]):
        ie = [i for i in range(i0 + 1, i1) if i not in used_e]
        ja = [j for j in range(j0 + 1, j1) if j not in used_a]
        pairs.update(_gap(ie, ja, scores))
    pairs.update(sure)  # those off the chain are reordered
    # merges: a clause wholly contained in one that covers more
    got_e, got_a = {i for i, _ in pairs}, {j for _, j in pairs}
    for i in set(range(n)) - got_e:
        many = [(x - scores.off(i, j), x, -j) for j, x in scores.e.reach(i, CONTAINED - 0.12).items()]
        _, x, j = max(many, default=(0.0, 0.0, 0))
        if x >= CONTAINED and sum(o > x - 0.12 for _, o, _ in many) == 1:
            pairs.add((i, -j))
    for j in set(range(m)) - got_a:
        many = [(y - scores.off(i, j), y, -i) for i, y in scores.a.reach(j, CONTAINED - 0.12).items()]
        _, y, i = max(many, default=(0.0, 0.0, 0))
        if y >= CONTAINED and sum(o > y - 0.12 for _, o, _ in many) == 1:
            pairs.add((-i, j))
    return sorted({(en.owner[i] + 1, ar.owner[j] + 1) for i, j in pairs})


def _gap(ie: list[int], ja: list[int], scores: Scores) -> list[tuple[int, int]]:
    """Best monotone alignment of a gap with beads 1-1, 1-2, 2-1, 1-0 and 0-1, row by row; only beads that better a state are kept."""
    if not ie or not ja:
        return []
    q, js = len(ja), np.array(ja)
    best, node = np.zeros(q + 1), np.full(q + 1, -1)
    waiting = None
    beads: list[tuple[np.ndarray, ...]] = []  # row, column, kind and bead before
    count = 0
    for x, i in enumerate(ie):
        ce, ca = scores.row(i, ja, js)
        both = np.sqrt(ce * ca)
        one, in_e, in_a = both >= GAP, ce >= CONTAINED, ca >= CONTAINED
        before, waiting = waiting, None
        if not (one.any() or in_e.any() or in_a.any()):
            continue
        off = scores.off(i, js)
        gains = np.full((3, q), -np.inf)
        if before is not None:
            gains[0] = np.where(in_e, before[0] + ce - off, -np.inf)
        gains[1, 1:] = np.where(in_a[1:] & in_a[:-1], best[:-2] + (ca - off)[1:] + (ca - off)[:-1], -np.inf)
        gains[2] = np.where(one, best[:-1] + both - off, -np.inf)
        if in_e.any():
            waiting = np.where(in_e, best[:-1] + ce - off, -np.inf), node[:-1]
        gain = gains.max(0)
        gain[gain <= best[1:] + SLACK] = -np.inf
        new = np.maximum.accumulate(np.maximum(best, np.append(-np.inf, gain)))
        step = np.flatnonzero(gain > new[:-1])
        if not len(step):
            continue
        kind = gains[:, step].argmax(0)
        prev = np.where(kind == 1, node[step - 1], node[step])
        if before is not None:
            prev = np.where(kind == 0, before[1][step], prev)
        beads.append((np.full(len(step), x, np.int32), step.astype(np.int32), kind.astype(np.int8), prev))
        # a state that got better ends with the last of these beads at or before it
        better = np.flatnonzero(new > best)
        node = node.copy()
        node[better] = count + np.searchsorted(step, better - 1, "right") - 1
        best = new
        count += len(step)
    out = []
    if beads:
        xs, ys, kinds, prevs = (np.concatenate(c) for c in zip(*beads))
        k = node[q]
        while k >= 0:
            x, y, kind = xs[k], ys[k], kinds[k]
            out.append((ie[x], ja[y]))
            if kind < 2:
                out.append((ie[x - 1], ja[y]) if kind == 0 else (ie[x], ja[y - 1]))
            k = prevs[k]
    return out


PAIRS = T.StructType([T.StructField("key", T.LongType()), T.StructField("en_sent", T.IntegerType()), T.StructField("ar_sent", T.IntegerType())])


ENTRIES = "array<struct<en:string,ar:string,dice:double>>"


def own_entries(texts: DataFrame, lex: DataFrame) -> DataFrame:
    """The texts with ``entries``: those of the lexicon for words of theirs, and of each word its best entry."""

    def words(batches):
        for b in batches:
            out = {(k, side, w) for k, x, y in zip(b["key"], b["en"], b["ar"]) for side, t in (("en", x), ("ar", y)) for ws in Side(t).words for w in ws}
            yield pd.DataFrame(sorted(out), columns=["key", "side", "w"])

    best = lex.select("*", F.row_number().over(Window.partitionBy("en").orderBy(F.desc("dice"), "ar")).alias("re"), F.row_number().over(Window.partitionBy("ar").orderBy(F.desc("dice"), "en")).alias("ra"))
    used = texts.mapInPandas(words, "key bigint, side string, w string").distinct()
    en, ar = used.filter("side = 'en'").select("key", F.col("w").alias("en")), used.filter("side = 'ar'").select("key", F.col("w").alias("ar"))
    of_en, of_ar = en.join(best, "en"), ar.join(best, "ar")
    found = of_en.join(ar, ["key", "ar"]).select("key", "en", "ar", "dice").unionByName(of_en.filter("re = 1").select("key", "en", "ar", "dice")).unionByName(of_ar.filter("ra = 1").select("key", "en", "ar", "dice")).distinct()
    per = found.groupBy("key").agg(F.collect_list(F.struct("en", "ar", "dice")).alias("entries"))
    return texts.join(per, "key", "left").withColumn("entries", F.coalesce("entries", F.expr(f"cast(array() as {ENTRIES})")))


def align_sentences(texts: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """key, en_sent, ar_sent for texts with columns key, en and ar.

    Null, empty and blank sides give no row; very long texts are read whole; of equally good partners the one
    nearer the diagonal counts; extra columns are ignored; repeated keys give repeated rows. A lexicon of more
    than most_entries is not sent to every task but joined to the texts' words, with the same result.
    """
    filled = texts.select("key", "en", "ar").filter("length(trim(en)) > 0 and length(trim(ar)) > 0")
    lex = lexicon(filled)
    if lex.count() <= most_entries:
        held = Lexicon((r["en"], r["ar"], r["dice"]) for r in lex.collect())

        def pair(batches):
            for b in batches:
                yield pd.DataFrame([(k, i, j) for k, x, y in zip(b["key"], b["en"], b["ar"]) for i, j in align(x, y, held)], columns=PAIRS.names)

        return filled.mapInPandas(pair, PAIRS)

    def pair_own(batches):
        for b in batches:
            yield pd.DataFrame([(k, i, j) for k, x, y, own in zip(b["key"], b["en"], b["ar"], b["entries"]) for i, j in align(x, y, Lexicon((r["en"], r["ar"], r["dice"]) for r in own))], columns=PAIRS.names)

    return own_entries(filled, lex).mapInPandas(pair_own, PAIRS)


def p5_found(spark, sf_dir: str) -> DataFrame:
    r = once(table(spark, sf_dir, "results").select(F.col("result_id").alias("key"), F.col("full_text_english").alias("en"), F.col("full_text_arabic").alias("ar")), "key")
    return align_sentences(r).select(F.col("key").alias("result_id"), "en_sent", "ar_sent").distinct()
