"""A bit array of fixed size that marks a set of keys: it lets tasks skip rows early, before an exact join.

Its size does not depend on the data; a crowded one only lets more rows through. Bits are set by a distributed
aggregation, so that no list of keys reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25


def _bit(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        out = (out ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def bits_of(keys: DataFrame, *columns: str) -> np.ndarray:
    """The bit array (as bytes) of the non-null long columns of ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(*(batch.column(c).to_numpy() for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], ["word", "mask"])

    found = keys.select(*columns).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint8)


def has_bit(bits: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    bit = _bit(*keys)
    return ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
