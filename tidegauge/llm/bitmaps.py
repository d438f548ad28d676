"""Bitmaps of fixed size that keep most of the unwanted out of heavy passes; exact joins follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an id bitmap; its size is the bound of what comes to the driver.
ID_BITS = 1 << 23
_WORD = 62


def bit_of(*keys: Column, bits: int = ID_BITS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)).cast("int")


def id_bitmap(bits_column: DataFrame, bits: int = ID_BITS) -> np.ndarray:
    """Packed words of the distinct values of the column ``bit``; at most bits / 62 rows are collected."""
    words = bits_column.groupBy(F.floor(F.col("bit") / _WORD).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % _WORD)).alias("bits"))
    rows = words.toPandas()
    mask = np.zeros(bits // _WORD + 1, np.int64)
    mask[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return mask


def passing(mask: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Positions of the bits that are set in the mask."""
    return np.flatnonzero((mask[bit // _WORD] >> (bit % _WORD)) & 1)
