"""A membership filter of fixed size, built by Spark from hashes.

It only lets tasks skip what cannot join; the join that follows is exact. Its size is a parameter and never grows with the data:
with more hashes than it can tell apart it lets more through, and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^25 bits are 4 MB.
BITS = 1 << 25


def build(df: DataFrame, hashes: str, bits: int = BITS):
    """Broadcast of the bitmap of ``hashes`` (longs). ``bits`` must be a power of two of at least 2^15."""
    slot = F.col(hashes).bitwiseAND(F.lit(bits - 1))
    parts = (
        df.select(slot.alias("slot")).where("slot is not null")
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("map"))
    )
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for bucket, part in parts.toLocalIterator():  # at most bits / 2^15 + 1 rows of 4 KB
        out[bucket * 4096 : bucket * 4096 + len(part)] = np.frombuffer(bytes(part), np.uint8)
    return df.sparkSession.sparkContext.broadcast((out, bits))


def contains(filter_value, hashes: np.ndarray) -> np.ndarray:
    out, bits = filter_value
    # Spark numbers the buckets from 1 for positions 1 .. 2^15, and position 0 falls into bucket 0's last bit pattern
    slot = (hashes & np.uint64(bits - 1)).astype(np.int64)
    bucket, bit = np.where(slot > 0, 1 + (slot - 1) // 32768, 0), np.where(slot > 0, (slot - 1) % 32768, 0)
    return (out[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0
