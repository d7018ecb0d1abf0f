"""Statistics of whole documents, computed for a batch at a time with numpy.

All figures come from the text alone. A text without words has zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .wordhash import _BASES, Words, _ranges, mix, split_words, text_bytes, window_hashes, word_hashes

#: Counts of the quality rules, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts.
MORE = ("n_chars", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_stops", "n_wide", "n_distinct", "n_short", "n_long", "n_caps_words", "n_digit_words", "n_top_word", "n_bare_lines")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(bytes(range(48, 58)))
_MARK, _STOP, _WIDE = _flags(b"!?"), _flags(b".,;:"), _flags(bytes(range(0xC0, 0x100)))
_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0x80:0xC0] = 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each text's range."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _by_doc(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """64-bit keys that are equal only within one document."""
    return mix(keys + (docs.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASES[1]))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key: how often it occurs, whether it is its first, and its group's number."""
    if not len(keys):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(bool), none
    _, first, group, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), dtype=bool)
    is_first[first] = True
    return counts[group], is_first, group


def _count(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)


def line_bounds(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line (split at line feeds)."""
    n = len(w.bounds) - 1
    feeds = np.flatnonzero(w.data == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(w.bounds, feeds, "right") - 1])
    start = np.concatenate([w.bounds[:-1], feeds + 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = w.bounds[1:][doc].copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    return start, end, doc


#: Bytes of texts that are counted at a time (one longer text is taken whole).
SPAN = 1 << 18


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts of every text, by name."""
    bounds, parts, at = text_bytes(texts)[1], [], 0
    while at < len(texts) or not parts:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SPAN, "right")) - 1)
        parts.append(_statistics(texts.slice(at, stop - at)))
        at = stop
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    w = split_words(texts)
    n = len(w.bounds) - 1
    out: dict[str, np.ndarray] = {"n_words": np.diff(w.first).astype(np.int64)}
    docs = np.repeat(np.arange(n), out["n_words"])
    chars = _CHAR[w.data]
    run = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(chars, out=run[1:])
    width = run[w.end] - run[w.start]
    out["word_chars"] = np.bincount(docs, weights=width, minlength=n).astype(np.int64)
    out["n_chars"] = run[w.bounds[1:]] - run[w.bounds[:-1]]
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_stops", _STOP), ("n_wide", _WIDE)):
        out[name] = _sums(flags[w.data], w.bounds)

    start, end, doc = line_bounds(w)
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    out["n_lines"] = _count(doc[has_word], n)
    last = np.where(end > start, w.data[np.maximum(end - 1, 0)] if len(w.data) else 0, 0)
    out["n_bare_lines"] = _count(doc[has_word & ~np.isin(last, list(b".!?:;\"'"))], n)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    lines = _ranges(w.data, start, end, _BASES[0]) + (end - start).astype(np.uint64)
    _, first, _ = _repeats(_by_doc(mix(lines), doc))
    out["n_dup_lines"] = _count(doc[~first], n)

    hashes = word_hashes(w)
    at, windows = window_hashes(hashes, w.first, 3)
    counts, _, _ = _repeats(_by_doc(windows, docs[at]))
    cover = np.zeros(len(hashes) + 4, dtype=np.int64)
    again = at[counts > 1]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    out["n_repeat_words"] = np.bincount(docs, weights=np.cumsum(cover)[: len(hashes)] > 0, minlength=n).astype(np.int64)

    counts, first, _ = _repeats(_by_doc(hashes, docs))
    out["n_distinct"] = _count(docs[first], n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, docs, counts)
    out["n_top_word"] = top
    out["n_short"] = _count(docs[width <= 3], n)
    out["n_long"] = _count(docs[width >= 12], n)
    upper, lower, digit = (np.concatenate([[0], np.cumsum(f[w.data])]) for f in (_UPPER, _LOWER, _DIGIT))
    has = lambda run: run[w.end] > run[w.start]
    out["n_caps_words"] = _count(docs[has(upper) & ~has(lower)], n)
    out["n_digit_words"] = _count(docs[has(digit)], n)
    return out


#: Ratios that describe a document whatever its length.
FEATURES = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks", "stops", "wide",
    "distinct", "short", "long", "caps_words", "digit_words", "top_word", "bare_lines", "words_a_line", "letters", "other",
)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One float row per document, in the order of FEATURES."""
    f = {k: v.astype(np.float64) for k, v in s.items()}
    words, chars, lines = (np.maximum(f[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    letters = f["n_upper"] + f["n_lower"]
    columns = (
        np.log1p(f["n_words"]), f["word_chars"] / words, f["n_symbols"] / words, f["n_dup_lines"] / lines, f["n_repeat_words"] / words,
        f["n_upper"] / np.maximum(letters, 1), f["n_digits"] / chars, f["n_marks"] / words, f["n_stops"] / words, f["n_wide"] / chars,
        f["n_distinct"] / words, f["n_short"] / words, f["n_long"] / words, f["n_caps_words"] / words, f["n_digit_words"] / words,
        f["n_top_word"] / words, f["n_bare_lines"] / lines, f["n_words"] / lines, letters / chars, (f["n_chars"] - letters - f["n_digits"] - f["n_wide"]) / chars,
    )
    return np.stack(columns, axis=1)
