"""Evaluation texts that leak into a corpus.

Size-partitioned MinHash containment search: windows of the short test items are the queries, overlapping chunks of
the documents the domain. Documents are partitioned by size; each partition has its own length of chunk and its own
number of MinHash values (one permutation, the least value of each of so many bins), enough that a window contained to
CONTAINMENT shares LEAST_SHARED values with probability RECALL. One pass over the documents, whatever the number of
items: shingles that no item's signature holds are sieved out, what is left is joined with the signatures by value,
and pairs of chunk and item that share enough are verified on their words by exact shingle containment along an
ordered chain. Only chunks that share values with an item travel; the items are never brought to the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.llm.langid import skeleton
from foliora.llm.sieve import BITS, sieve
from foliora.sources.tables import table

#: Words of a shingle, of an item's window, and the step between windows.
SHINGLE, WINDOW, STEP = 3, 25, 5
#: Partitions by the number of shingles of a document: upper bound, length of a chunk. Chunks overlap by OVERLAP shingles, more than a window has.
PARTS, OVERLAP = ((64, 64), (512, 128), (1 << 62, 256)), 32
#: A window is looked for down to this containment, with this probability, by so many common values.
CONTAINMENT, RECALL, LEAST_SHARED = 0.45, 0.999, 3
#: Words of a passage, the words at its ends that may be changed where others in it are, least share of its shingles matched, most words between two matched shingles.
LEAST_WORDS, ENDS, LEAST_SHARE, GAP = 25, 2, 0.6, 9

_TOKEN = re.compile(r"[^\W_]+")
_PRIME = (1 << 31) - 1


@lru_cache(maxsize=400_000)
def _forms(raw: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(skeleton(raw)))


def words_of(text: str | None) -> list[str]:
    """The words of a text: look-alike characters unified, no case, no punctuation."""
    return [w for raw in (text or "").split() for w in _forms(raw)]


class Hashes(dict):
    """Printed word to the hash of its word; a printed word of none or several words is kept apart."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        f = _forms(raw)
        h = self[raw] = zlib.crc32(f[0].encode()) % _PRIME if len(f) == 1 else -1
        return h

    def of(self, text: str) -> np.ndarray:
        raws = text.split()
        h = np.fromiter(map(self.__getitem__, raws), np.int64, len(raws))
        odd = np.nonzero(h < 0)[0]
        if not len(odd):
            return h
        parts, at = [], 0
        for k in odd.tolist():
            parts += [h[at:k], np.array([zlib.crc32(w.encode()) % _PRIME for w in _forms(raws[k])], np.int64)]
            at = k + 1
        return np.concatenate([*parts, h[at:]])


def shingles(words: np.ndarray) -> np.ndarray:
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    h = words[: len(words) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h = (h * 1_000_003 + words[k : len(words) - SHINGLE + 1 + k]) % _PRIME
    return h


@lru_cache(maxsize=None)
def bins(chunk: int) -> int:
    """MinHash values that a partition compares: the fewest with which a contained window is found.

    Of ``shared`` shingles in a union of u, one is the least of its bin with a chance of about (1 - exp(-u/b)) / (u/b).
    """
    q = WINDOW - SHINGLE + 1
    shared = math.floor(CONTAINMENT * q)
    u = chunk + q - shared
    for b in range(16, 100_000, 16):
        s = (1 - math.exp(-u / b)) / (u / b)
        if sum(math.comb(shared, k) * s**k * (1 - s) ** (shared - k) for k in range(LEAST_SHARED)) <= 1 - RECALL:
            return b
    raise ValueError("no number of bins is enough")


def signature(h: np.ndarray, b: int) -> np.ndarray:
    """The least shingle of each of b bins, of those that any falls in."""
    least = np.full(b, _PRIME, np.int64)
    np.minimum.at(least, h % b, h)
    return least[least < _PRIME]


def part_of(n: int) -> int:
    return next(k for k, (most, _) in enumerate(PARTS) if n <= most)


def chunk_starts(n: int, chunk: int) -> range:
    """Starts of chunks such that every run of OVERLAP shingles lies in one."""
    return range(0, max(1, n - OVERLAP), chunk - OVERLAP)


def passage(doc: list[str], item: list[str]) -> tuple[int, float]:
    """Longest ordered chain of shingles that both hold, compared as words: words of the item that it spans (with the ones that go on after a changed word at its ends), share of its shingles matched."""
    places: dict[tuple, list[int]] = {}
    for j in range(len(item) - SHINGLE + 1):
        places.setdefault(tuple(item[j : j + SHINGLE]), []).append(j)
    chains: list[list[int]] = []  # first and last place in the item, first and last in the document, matches
    done: list[list[int]] = []
    for i in range(len(doc) - SHINGLE + 1):
        found = places.get(tuple(doc[i : i + SHINGLE]))
        if not found:
            continue
        keep = []
        for c in chains:
            (keep if i - c[3] <= GAP else done).append(c)
        chains = keep
        for j in found:
            best = None
            for c in chains:
                if 0 < j - c[1] <= GAP and c[3] < i and (best is None or c[4] > best[4]):
                    best = c
            chains.append([best[0], j, best[2], i, best[4] + 1] if best is not None else [j, j, i, i, 1])
    done += chains
    if not done:
        return 0, 0.0
    first, last, begin, end, n = max(done, key=lambda c: (c[4], c[1] - c[0]))
    more = _beyond(doc[end + SHINGLE :], item[last + SHINGLE :]) + _beyond(doc[:begin][::-1], item[:first][::-1])
    return last - first + SHINGLE + more, n / (last - first + 1)


def _beyond(doc: list[str], item: list[str]) -> int:
    """Words of the item up to the last of one or two that go on after one replaced, added or dropped word."""
    for skip_doc, skip_item in ((1, 1), (1, 0), (0, 1)):
        n = 0
        while n < 2 and skip_doc + n < len(doc) and skip_item + n < len(item) and doc[skip_doc + n] == item[skip_item + n]:
            n += 1
        if n:
            return skip_item + n
    return 0


def is_leak(words: int, share: float) -> bool:
    """Long enough: LEAST_WORDS, or up to ENDS fewer where words in between are changed, as those at the ends may be too."""
    return share >= LEAST_SHARE and words >= LEAST_WORDS - (ENDS if share < 1 else 0)


VALUES = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("value", T.LongType())])
CHUNKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("shared", T.ArrayType(T.LongType())), T.StructField("words", T.StringType())])
LEAK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("share", T.DoubleType())])


def item_signatures(items: DataFrame) -> DataFrame:
    """item_id, window, part, value: MinHash values of every window of every item, for each partition of documents."""

    def sign(batches):
        hashes = Hashes()
        w = WINDOW - SHINGLE + 1
        for b in batches:
            out = []
            for i, text in zip(b["item_id"], b["text"]):
                h = shingles(hashes.of(text))
                n = len(h)
                for s in sorted({*range(0, max(1, n - w + 1), STEP), max(0, n - w)}) if n else ():
                    for part, (_, chunk) in enumerate(PARTS):
                        out += [(i, s, part, v) for v in signature(h[s : s + w], bins(chunk)).tolist()]
            yield pd.DataFrame(out, columns=VALUES.names)

    return items.mapInPandas(sign, VALUES)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, words, share (of the longest passage within a chunk), once for every document that holds a passage of an item.

    documents: doc_id, text; items: item_id, text. Null ids, null, empty and very short texts give no row; very long
    texts are read whole, in chunks; repeated rows give one row; of items with one id and several texts each text
    counts; extra columns are ignored; an empty table gives an empty result.
    """
    from foliora.session import cut_lineage

    asked = items.select("item_id", "text").filter("item_id is not null and text is not null and text != ''").distinct()
    signed = cut_lineage(item_signatures(asked).distinct())
    held = sieve(signed, F.col("value"))

    def search(batches):
        hashes = Hashes()
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                h = shingles(hashes.of(text))
                hit = held.pick(h & (BITS - 1))
                if np.count_nonzero(hit) < LEAST_SHARED:
                    continue
                before = np.concatenate(([0], np.cumsum(hit)))
                part = part_of(len(h))
                chunk, words = PARTS[part][1], None
                for k, s in enumerate(chunk_starts(len(h), chunk)):
                    z = min(len(h), s + chunk)
                    if before[z] - before[s] < LEAST_SHARED:
                        continue
                    sig = signature(h[s:z], bins(chunk))
                    sig = sig[held.pick(sig & (BITS - 1))]
                    if len(sig) >= LEAST_SHARED:
                        words = words_of(text) if words is None else words
                        out.append((doc, k, part, sig.tolist(), " ".join(words[s : z + SHINGLE - 1])))
            yield pd.DataFrame(out, columns=CHUNKS.names)

    chunks = cut_lineage(documents.select("doc_id", "text").filter("doc_id is not null and text is not null and text != ''").mapInPandas(search, CHUNKS))
    meet = chunks.select("doc_id", "chunk", "part", F.explode("shared").alias("value")).join(signed, ["part", "value"])
    near = meet.groupBy("doc_id", "chunk", "item_id", "window").agg(F.count_distinct("value").alias("n")).filter(F.col("n") >= LEAST_SHARED).select("doc_id", "chunk", "item_id").distinct()
    pairs = near.join(chunks.select("doc_id", "chunk", "words"), ["doc_id", "chunk"]).join(asked, "item_id").select("doc_id", "item_id", "words", "text")

    def verify(batches):
        for b in batches:
            out = []
            for doc, i, words, text in zip(b["doc_id"], b["item_id"], b["words"], b["text"]):
                n, share = passage(words.split(" "), words_of(text))
                if is_leak(n, share):
                    out.append((doc, i, n, share))
            yield pd.DataFrame(out, columns=LEAK.names)

    found = pairs.mapInPandas(verify, LEAK)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("words", "share"), F.struct("words", "share")).alias("p")).select("doc_id", "item_id", "p.words", "p.share")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")
