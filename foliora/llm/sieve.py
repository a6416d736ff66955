"""A bit set of fixed size over the hashes of a column: a pre-filter that every task can hold, however many values there are.

The set is built by a distributed aggregate (bitmaps of 4 KB each, at most 2048 of them) and has no false negatives;
what passes is joined exactly afterwards, so a full set costs time, never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the set (8 MB); bitmap buckets hold 32768 of them.
BITS, BUCKET = 1 << 26, 1 << 15


class Sieve:
    """Places that are set, as packed bits."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed

    def has(self, place: int) -> bool:
        return bool(self.packed[place >> 3] >> (place & 7) & 1)

    def pick(self, places: np.ndarray) -> np.ndarray:
        """Which of the places are set."""
        return (self.packed[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def sieve(df: DataFrame, place: Column) -> Sieve:
    """The set of place modulo BITS over all rows (place: a bigint that is not negative); at most BITS / BUCKET rows come to the driver."""
    p = F.pmod(place, F.lit(BITS)) + 1  # buckets begin at 1
    rows = df.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    packed = np.zeros(BITS >> 3, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * (BUCKET >> 3)
        packed[at : at + (BUCKET >> 3)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Sieve(packed)
