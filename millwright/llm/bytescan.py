"""Vectorised scans over the bytes of Arrow string columns.

All functions take the raw UTF-8 buffer of a batch (documents laid end to end) and work on the
whole batch at once, so no Python object is made per word or byte.  Hashes are 64-bit polynomial
sums followed by a mixer; two different strings get the same value with probability about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHORT = np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)  # marks sequences shorter than a shingle
_SHINGLE_BASE = np.uint64(0xD1342543DE82EF95)


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_VALUES = _byte_values()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift multiply), so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = at[:-1][at[:-1] < n]
    before[firsts] = False                      # a word never crosses into the next document
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at).astype(np.int64)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) in order, and word offsets per document."""
    start, end, first = _word_bounds(raw, at)
    if len(start) == 0:
        return np.zeros(0, np.uint64), first
    n = len(raw)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[_LOWER[raw]] * powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(_BASE_INV, n)[start]), first


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, document after document, and their offsets.

    A document with 1 .. k-1 words has its whole word sequence as its only shingle; one without
    words has none.
    """
    w, first = words(raw, at)
    n_words = np.diff(first)
    n_out = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_at = np.concatenate([[0], np.cumsum(n_out)])
    if len(w) == 0:
        return np.zeros(0, np.uint64), out_at
    rolled = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    scale = powers(_SHINGLE_BASE, k)
    for j in range(k):
        rolled += w[j: j + len(rolled)] * scale[j]
    pos = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - first[:-1], n_out)
    out = np.empty(out_at[-1], np.uint64)
    whole = np.repeat(n_words >= k, n_out)
    out[whole] = rolled[pos[whole]]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        part = w[first[d]: first[d + 1]]
        out[out_at[d]] = (part * scale[: len(part)]).sum(dtype=np.uint64) ^ _SHORT[len(part) % len(_SHORT)]
    return mix(out), out_at


def distinct_per_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the new offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of every byte string raw[i : i + size]."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[raw] * powers(_BASE, len(raw)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_BASE_INV, n))


def chunks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as they stand (no lower-casing): hash, first byte, end byte, and word offsets per document."""
    start, end, first = _word_bounds(raw, at)
    if len(start) == 0:
        return np.zeros(0, np.uint64), start, end, first
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[raw] * powers(_BASE, len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_BASE_INV, len(raw))[start]), start, end, first
