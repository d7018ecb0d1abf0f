"""Vectorised word hashing over Arrow string arrays.

A batch of texts is handled as one byte buffer: white space is found by a
table lookup, words are runs of other bytes, and every word gets a 64-bit hash
from a prefix polynomial, so the cost is a few numpy passes per byte and no
Python object is made per word.

Words are ``[^\\x20\\x09-\\x0D]+``. All these separators are single ASCII bytes,
so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Words of a batch: byte bounds, document index, and the batch's bytes."""

    data: np.ndarray  # uint8, all texts end to end
    bounds: np.ndarray  # int64, n_docs + 1 byte offsets
    start: np.ndarray  # int64 per word
    end: np.ndarray  # int64 per word
    first: np.ndarray  # int64, n_docs + 1 offsets into the words


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None and len(texts) else np.zeros(0, np.uint8)
    return data, (off - off[0]).astype(np.int64)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Find the words of every text of a batch (lower: A-Z folded first)."""
    data, bounds = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SEP[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over the border of two texts is two words
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _tables.get(base, (np.ones(1, np.uint64),) * 2)
    if len(power) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        power, inverse = np.cumprod(steps), np.cumprod(back)
        _tables[base] = power, inverse
    return power, inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that are hashed at a time; the tables of powers stay in the cache.
SPAN = 1 << 19


def _ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of data[start:end] for each pair, free of its place.

    Starts and ends ascend. Bytes are taken a stretch at a time, so memory does
    not grow with the batch.
    """
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        low = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, low + SPAN, "right")))
        values = data[low : int(end[stop - 1])].astype(np.uint64) + np.uint64(1)
        power, inverse = _powers(len(values) + 1, base)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=total[1:])
        out[at:stop] = (total[end[at:stop] - low] - total[start[at:stop] - low]) * inverse[start[at:stop] - low]
        at = stop
    return out


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word (seed 0 or 1: two independent families)."""
    raw = _ranges(w.data, w.start, w.end, _BASES[seed])
    return mix(raw + (w.end - w.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text.

    Returns (index of the first word of each window, hash). Windows that would
    run over the end of a text are left out.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(n - size + 1, np.uint64)
    for k in range(size):  # Horner over few words; exact in wrap-around arithmetic
        acc *= np.uint64(_BASES[1 - seed])
        acc += hashes[k : n - size + 1 + k]
    last = np.repeat(first[1:], np.diff(first))  # end of the text of each word
    at = np.flatnonzero(np.arange(n - size + 1) + size <= last[: n - size + 1])
    return at, mix(acc[at])


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal neighbours."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True))
