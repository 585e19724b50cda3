"""A bit filter of fixed size over hashed keys, built by Spark and read in Arrow stages.

It only lets rows through that a later join could find; a bit that is set by
another key costs a row, never a result. Its 16 MB don't grow with the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27


def bit_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def build(bits: DataFrame) -> Broadcast:
    """The filter of a table with one column ``bit``."""
    parts = bits.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    filled = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * 4096  # buckets count from 1, and so do their bits
        filled[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits.sparkSession.sparkContext.broadcast(filled)


def holds(filled: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filled[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
