"""A set of 64-bit keys of any number in a bitset of bounded size, for tasks to ask.

It answers yes for every key put in and for a few others, so whoever asks must be right either
way: what passes is counted or joined exactly, what doesn't needn't move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and the largest filter: 8 KB and 16 MB. More keys than the largest one has room for make it let more pass.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
BITS_PER_KEY = 16


@dataclass(frozen=True)
class KeyFilter:
    """``words`` holds the bits; each key sets two of them, by its low and its high half."""

    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Of each key (uint64, well mixed) whether it may be in the set."""
        last = np.uint64(len(self.words) * 64 - 1)
        out = np.ones(len(keys), bool)
        for place in (keys & last, (keys >> np.uint64(32)) & last):
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def joined(self, other: KeyFilter) -> KeyFilter:
        """Both sets; the filters have one size."""
        return KeyFilter(self.words | other.words)


def bits_for(n: int) -> int:
    """Bits of a filter of n keys: a power of two within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_KEY * n - 1).bit_length()))


def of_keys(keys: DataFrame, column: str, bits: int) -> KeyFilter:
    """The filter of a column of keys (long; nulls are left out). Tasks set bits in 64-bit words, which are merged by bit_or.

    At most bits / 64 rows reach the driver, whatever the number of keys. An empty table gives an empty filter.
    """
    if not MIN_BITS <= bits <= MAX_BITS or bits & (bits - 1):
        raise ValueError(f"bits must be a power of two from {MIN_BITS} to {MAX_BITS}")
    place: Callable[[Column], Column] = lambda c: c.bitwiseAND(F.lit(bits - 1).cast("long"))
    places = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(place(F.col(column)), place(F.shiftrightunsigned(column, 32)))).alias("p"))
    mask = F.expr("shiftleft(1L, cast(p & 63 as int))")
    rows = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return KeyFilter(words)
