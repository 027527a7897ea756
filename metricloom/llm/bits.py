"""A filter of fixed size that tells which hashes can be in a set: 8 MB, whatever the set's size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def filter_of(df: DataFrame, hash_: Column) -> np.ndarray:
    """A bit for the leading bits of every hash; tasks set their own, so at most 2**20 words reach the driver."""
    place = F.shiftrightunsigned(hash_, 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    rows = df.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), dtype=np.int64)
    bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64)


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False for hashes that are not in the set; true for those that are, and for some others."""
    place = hashes >> np.uint64(64 - BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
