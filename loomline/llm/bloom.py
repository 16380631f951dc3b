"""Blocked Bloom filters of a fixed largest size.

One hash picks a block of 256 bits, eight parts of another set one bit in each of
its eight words, so a lookup touches 32 bytes.  Every task sets its own keys' bits
and the blocks are united by an aggregation; the driver holds the filter, never the
keys.  More keys than the filter is made for raise the share of false positives,
not its size; whatever passes is meant to be joined exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and blocks of 32 bytes a filter has at most.
BITS, MOST_BLOCKS = 12, 1 << 20


def hashes(key: Column) -> tuple[Column, Column]:
    """h picks the block, w the bits."""
    return F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("w")


def build(keys: DataFrame, *columns: str) -> np.ndarray:
    """Blocks x 8 words of the distinct or repeated keys in ``columns`` (hashed together if several)."""
    n = keys.count()
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * 256 < n * BITS:
        blocks *= 2
    key = F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)
    h, w = hashes(key)
    word = lambda i: F.expr(f"bit_or(shiftleft(1, cast(shiftrightunsigned(w, {5 * i}) & 31 as int)))").alias(f"w{i}")
    rows = keys.select(h, w).groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(*map(word, range(8))).toArrow()
    table = np.zeros((blocks, 8), np.uint32)
    at = rows.column("block").to_numpy()
    for i in range(8):
        table[at, i] = rows.column(f"w{i}").to_numpy().astype(np.int32).view(np.uint32)
    return table


def holds(table: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter, by their two hashes as 64-bit integers."""
    row = table[h % len(table)]
    bits = np.ascontiguousarray(w).view(np.uint64)
    hit = np.ones(len(h), bool)
    for i in range(8):
        hit &= (row[:, i] >> ((bits >> np.uint64(5 * i)) & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return hit
