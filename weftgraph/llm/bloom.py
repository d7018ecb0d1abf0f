"""A Bloom filter over long keys, sized by their number.

It is built by one bounded aggregate (a row for every 64 bits) and shipped with
a task's code: eight bits or more a key, 1 MB at least, and at most 8 MB. Beyond
MOST_KEYS there is no filter, and callers join with the keys instead. Two probes
let one foreign key in twenty through at most; callers must not depend on less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

LEAST_BITS, MOST_BITS = 1 << 23, 1 << 26
#: Keys beyond which a filter would be too large to ship.
MOST_KEYS = MOST_BITS // 8


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(keys.astype(np.int64).view(np.uint64))
    low = np.uint64(bits - 1)
    return (mixed & low).astype(np.int64), ((mixed >> np.uint64(32)) & low).astype(np.int64)


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for p in _probes(batch["key"].to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(slots, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        full = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(slots[full].view(np.int64))], names=["slot", "bits"])

    return run


def filter_of(keys: DataFrame) -> np.ndarray | None:
    """The filter of a DataFrame with one long column, key, without nulls; None for too many keys.

    The keys are counted first, so they should be cheap to read again.
    """
    count = keys.count()
    if count > MOST_KEYS:
        return None
    bits = LEAST_BITS
    while bits < 8 * count:
        bits *= 2
    slots = keys.select(F.col("key").cast("long").alias("key")).mapInArrow(_fill(bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return out.view(np.uint64)


def held(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold; without a filter, all."""
    if bits is None:
        return np.ones(len(keys), bool)
    a, b = _probes(keys, 64 * len(bits))
    one = lambda p: (bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
    return (one(a) & one(b)).astype(bool)
