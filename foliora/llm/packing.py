"""Texts packed into containers of fixed capacity with little space left, none split unless it alone exceeds one.

Minimum bin slack: each container takes the largest text left and then the multiset of remaining lengths that
comes closest to its capacity, found by a subset-sum dynamic program over bitsets (bounded counts by binary
splitting) and read back from it. Containers never cross a shard: texts are spread evenly over shards by a
hash, as many as the corpus needs, so every shard packs on its own and wastes at most its last container.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.session import cut_lineage
from foliora.sources.tables import table

#: Path of the public tokenizer's ranks, texts for each shard.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SHARD_TEXTS = 4000
#: Capacities that one pass over the texts takes; more are taken in several.
LIMITS_A_PASS = 1000
# Fixed value: how the tokenizer's vocabulary expects text to be split.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("foliora", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The rows' doc_id with n_tokens of their whole text; null texts count as empty."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        enc = encoding(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return texts.select("doc_id", "text").mapInPandas(count, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths (length to count, at most ``counts``) with the largest sum not above ``room``."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for size in sorted((s for s in counts if counts[s] > 0 and s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:  # powers of two, so that a count takes log steps
            n = min(take, left)
            new = reach | (reach << (size * n)) & mask
            if new != reach:
                steps.append((size, n, reach))
                reach = new
            left -= n
            take *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for size, n, before in reversed(steps):
        if not (before >> total) & 1:
            out[size] = out.get(size, 0) + n
            total -= size * n
    return out


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of places in ``lengths``, all lengths 1 to capacity."""
    by_size: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        by_size.setdefault(n, []).append(k)
    for places in by_size.values():
        places.reverse()  # so that pop takes the first
    counts = {n: len(p) for n, p in by_size.items()}
    out = []
    while counts:
        largest = max(counts)
        chosen = {largest: 1}
        counts[largest] -= 1
        for n, k in fill(counts, capacity - largest).items():
            chosen[n] = chosen.get(n, 0) + k
            counts[n] -= k
        out.append([by_size[n].pop() for n in sorted(chosen, reverse=True) for _ in range(chosen[n])])
        for n in chosen:
            if not counts[n]:
                del counts[n]
    return out


PACKED = T.StructType([T.StructField("limit_id", T.IntegerType()), T.StructField("container", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType())])


def pack_documents(counted: DataFrame, limits: DataFrame, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """limit_id, container, doc_id, first_token, n_tokens: every text in one container of each capacity.

    counted: doc_id, n_tokens (one row for each text); limits: limit_id, capacity_tokens. A text longer than a
    capacity is cut into full pieces, each a container of its own, and a rest that is packed like a text. Texts
    without tokens are placed with n_tokens 0 in a container of their shard. Null or non-positive capacities
    give no row; repeated texts are packed as often as they come; empty tables give an empty result; ties go to
    the smaller doc_id.
    """
    counted = counted.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).filter("doc_id is not null")
    shards = max(1, -(-counted.count() // shard_texts))
    caps = limits.select(F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").cast("int").alias("capacity")).filter("limit_id is not null and capacity > 0").dropDuplicates(["limit_id"])
    kinds = caps.orderBy("limit_id").collect()  # the stated sizes of containers
    if not kinds:
        return counted.sparkSession.createDataFrame([], PACKED)
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def sized(block: list) -> DataFrame:
        each = F.array(*[F.struct(F.lit(r["limit_id"]).alias("limit_id"), F.lit(r["capacity"]).alias("capacity")) for r in block])
        return sharded.select("doc_id", "n_tokens", "shard", F.explode(each).alias("c")).select("doc_id", "n_tokens", "shard", "c.limit_id", "c.capacity")

    rows = sized(kinds[:LIMITS_A_PASS])
    for k in range(LIMITS_A_PASS, len(kinds), LIMITS_A_PASS):
        rows = rows.unionByName(sized(kinds[k : k + LIMITS_A_PASS]))

    def one(b: pd.DataFrame) -> pd.DataFrame:
        limit, capacity, shard = int(b["limit_id"].iloc[0]), int(b["capacity"].iloc[0]), int(b["shard"].iloc[0])
        b = b.sort_values(["doc_id", "n_tokens"], kind="stable")
        pieces, out, boxes = [], [], 0
        for doc, n in zip(b["doc_id"].tolist(), b["n_tokens"].tolist()):
            at = 0
            while n - at > capacity:
                out.append((limit, f"{limit}-{shard}-{boxes}", doc, at, capacity))
                boxes += 1
                at += capacity
            pieces.append((doc, at, n - at))
        filled = [p for p in pieces if p[2] > 0]
        for box in pack([p[2] for p in filled], capacity):
            out += [(limit, f"{limit}-{shard}-{boxes}", *filled[k]) for k in box]
            boxes += 1
        out += [(limit, f"{limit}-{shard}-{max(0, boxes - 1)}", *p) for p in pieces if p[2] == 0]
        return pd.DataFrame(out, columns=PACKED.names)

    return rows.groupBy("limit_id", "shard").applyInPandas(one, PACKED)


def p7_pack(spark, sf_dir: str) -> DataFrame:
    counted = cut_lineage(token_counts(table(spark, sf_dir, "documents")))
    return pack_documents(counted, table(spark, sf_dir, "pack_limits"))
