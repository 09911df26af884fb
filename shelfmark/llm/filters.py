"""Bit filters of fixed size: whether a table may hold a 64-bit key.

A filter that fills up lets more keys through; it never holds one back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W

#: Logarithm of the bits of a filter.
FILTER_BITS = 26


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hashed key, packed; tasks hand on the words of the table that have a bit, the driver holds the table."""

    def mark(batches):
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[_places(batch.column(0).to_numpy(), bits)] = True
        packed = np.packbits(table, bitorder="little").view(np.int64)
        word = np.flatnonzero(packed)
        for k in range(0, len(word), 100_000):
            yield pa.record_batch({"word": pa.array(word[k : k + 100_000]), "marks": pa.array(packed[word[k : k + 100_000]])})

    found = keys.coalesce(4).mapInArrow(mark, "word long, marks long").groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[found["word"].to_numpy()] = found["marks"].to_numpy()
    return out.view(np.uint8)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = _places(keys, (len(table) * 8).bit_length() - 1)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
