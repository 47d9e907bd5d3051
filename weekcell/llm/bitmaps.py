"""Bitmaps of fixed size: they only let rows pass that an exact join still decides about, so a full one costs time, not results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(column: Column, bits: int) -> Column:
    """The bit of a value."""
    return F.pmod(F.xxhash64(column), F.lit(bits))


def build(slots: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a column ``slot`` (0 to bits - 1): bits / 8 bytes on the driver, whatever the number of rows."""
    rows = (slots.select((F.col("slot") + 1).alias("slot"))  # Spark's buckets hold 1 to 32768, 32769 to 65536, ...
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    out = np.zeros(-(-bits // 32768) * 4096, dtype=np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def holds(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
