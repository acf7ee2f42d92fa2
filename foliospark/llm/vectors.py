"""Whole-batch text arithmetic with numpy: words, rolling hashes, window anchors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the polynomial hashes (fixed values) and their inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
ITEM_BASE = 0xC2B2AE3D27D4EB4F | 1
#: Bytes of text handled together; a longer document is handled alone.
BATCH_BYTES = 500_000

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(12, (n + 1).bit_length())
    return _powers(base, size)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each values[start:end]; equal ranges get equal hashes wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    part = (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]
    return mix64(part + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each window of `width` values: len(values) - width + 1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * powers(inverse(base), n))


def batches(array, limit: int = BATCH_BYTES):
    """Of an Arrow string or binary array: (first row, bytes, document starts, document ends) for groups of rows; null is empty."""
    import pyarrow as pa

    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(array):
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), len(array))
        yield a, data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words (runs without the six ASCII spaces, within documents) and the document of each."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    inside = ~_SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    filled = np.flatnonzero(ends > starts)
    return at, to, filled[np.searchsorted(starts[filled], at, side="right") - 1]


def word_hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    return range_hashes(data.astype(np.uint64) + np.uint64(1), at, to, BYTE_BASE)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` gram hashes the place of the least, leftmost of equals: it depends on the window's content only."""
    if len(grams) >= 1 << 32:
        raise ValueError("too many places in one batch")
    place = np.uint64(max(1, (len(grams) - 1).bit_length()))
    keyed = (grams >> place << place) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(keyed, span) & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
