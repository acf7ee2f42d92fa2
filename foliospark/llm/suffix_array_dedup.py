"""Removal of byte strings that occur twice anywhere, by merged Burrows-Wheeler transforms.

The contexts of a group's anchors (to the right, and to the left reversed) are strings of eight-byte symbols. They are
split into shards, each with its own Burrows-Wheeler transform over all rotations of its strings. The transforms
are merged by refining their interleave: a round deals the entries out by their transformed symbols, in the order so
far, which orders them by one symbol more; no suffix is sorted again and no text is looked at. Two neighbours part in
the round that first tells them apart, and that round is their common prefix. Contexts that agree over a whole window,
some bytes to the left and the rest to the right, are the repeated intervals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import repeats, store, vectors

WINDOW = 400
#: Bytes that a group's prefix can have; the last resort is the whole window.
GRAMS = (100, 200)
#: Strings of a shard.
SHARD = 2048


def contexts(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, step: int, most: int) -> np.ndarray:
    """Up to `most` bytes from each `begin` forwards (step 1) or backwards (-1), as rows of big-endian 8-byte symbols, zero filled."""
    wide = (most + 7) // 8 * 8
    out = np.zeros((len(begin), wide), dtype=np.uint8)
    owner = np.repeat(np.arange(len(begin)), length)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    out[owner, at] = raw[begin[owner] + step * at]
    return out.view(">u8").astype(np.uint64)


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes in which unequal symbols agree."""
    differ = a ^ b
    out = np.zeros(len(differ), dtype=np.int64)
    for k in range(1, 8):
        out += differ < np.uint64(1 << (64 - 8 * k))
    return out


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of the rows of `symbols` (whole numbers over 0), each closed by symbol 0.

    All rotations of all rows are in order, equal ones by row. Returns for each the symbol before it, cyclically, and
    the row whose beginning it is (-1 for a rotation that begins elsewhere).
    """
    n, wide = symbols.shape[0], symbols.shape[1] + 1
    closed = np.zeros((n, wide), dtype=np.int64)
    closed[:, :-1] = symbols
    rank, step = closed, 1
    while step < wide:
        key = rank << 32 | np.roll(rank, -step, axis=1)
        rank = np.unique(key, return_inverse=True)[1].reshape(n, wide).astype(np.int64)
        step *= 2
    order = np.argsort(rank.T.ravel(), kind="stable")  # row by row among equals
    column, row = order // n, order % n
    return closed[row, column - 1], np.where(column == 0, row, -1)


def _distributed(keys: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers under 2**32, in linear time."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    return order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")] if keys.max(initial=0) >> 16 else order


def merge(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms `parts` and the symbols that each entry has in common with the one before it.

    The interleave is the place of each entry in the concatenated transforms. It begins as their concatenation, ordered
    by no symbol. Each round is a stable distribution of the entries by transformed symbol; blocks of entries that
    no round has told apart are split further until a round splits none.
    """
    before = np.concatenate(parts).astype(np.int32)
    shard = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    n = len(before)
    at, block = np.arange(n), np.zeros(n, dtype=np.int32)
    common = np.full(n, -1, dtype=np.int32)
    own, matched = shard, 0
    while n:
        symbol = before[at]
        dealt = _distributed(symbol)
        symbol, own, block = symbol[dealt], own[dealt], block[dealt]
        # What follows a closing symbol is a new string: all that agree so far are one block.
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        at[_distributed(own)] = np.arange(n)
        parted = fresh & (common < 0)
        if not parted.any():
            break
        common[parted] = matched
        block, matched = np.cumsum(fresh, dtype=np.int32), matched + 1
    common[common < 0] = np.iinfo(np.int32).max
    return at, common


def merged_order(symbols: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `symbols` (eight-byte numbers) and the bytes each has in common with the one before it."""
    n, wide = symbols.shape
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    dense = (np.unique(symbols, return_inverse=True)[1] + 1).reshape(n, wide)
    shards = [(a, *transform(dense[a : a + shard])) for a in range(0, n, shard)]
    at, common = merge([before for _, before, _ in shards])
    begins = np.concatenate([np.where(row < 0, -1, row + a) for a, _, row in shards])[at]
    first = np.flatnonzero(begins >= 0)
    order = begins[first]
    # Rows that follow each other have in common the least of what lies between them.
    shared = np.minimum(np.minimum.reduceat(common[: first[-1] + 1], np.append(0, first[:-1] + 1)), wide).astype(np.int64)
    shared[0] = 0
    out = shared * 8
    part = np.flatnonzero((shared < wide) & (np.arange(len(order)) > 0))
    out[part] += _common_bytes(symbols[order[part], shared[part]], symbols[order[part - 1], shared[part]])
    return order, out


def interval_cover(window: int):
    def covered(ahead, many, data, ka):
        ((_, raw, starts, ends),) = vectors.batches(data, limit=1 << 62)
        n = len(many)
        middle = starts + ahead
        nearest = ahead - many + 1  # distance from the last window's start to the anchor
        right = contexts(raw, middle, ends - middle, 1, window)
        left = contexts(raw, middle - 1, ahead, -1, int(ahead.max()) or 1)
        places, runs = [], []
        for symbols in (left, right):
            order, common = merged_order(symbols)
            place = np.empty(n, dtype=np.int64)
            place[order] = np.arange(n)
            places.append(place)
            runs.append(common)
        after = [np.append(c[1:], 0) for c in runs]
        reach = [np.maximum(c, a)[p] for c, a, p in zip(runs, after, places)]
        low, high = np.full(n, 1 << 40), np.full(n, -1)
        for l in range(int(nearest.min()), int(ahead.max()) + 1):
            live = np.flatnonzero((nearest <= l) & (l <= ahead) & (reach[0] >= l) & (reach[1] >= window - l))
            if len(live) < 2:
                continue
            key = np.cumsum(runs[0] < l)[places[0][live]] << 32 | np.cumsum(runs[1] < window - l)[places[1][live]]
            order = np.argsort(key, kind="stable")
            equal = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(live), dtype=bool)
            twice[1:] |= equal
            twice[:-1] |= equal
            hit = live[order[twice]]
            low[hit] = np.minimum(low[hit], ahead[hit] - l)
            high[hit] = np.maximum(high[hit], ahead[hit] - l)
        rows = np.flatnonzero(high >= 0)
        return rows, low[rows], high[rows]

    return covered


def suffix_array_dedup(df: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept (the other bytes) for each row of `df` (doc_id, text).

    A byte goes if it is in a `window`-byte string that starts at another place too, in any document or its own.
    Matches never cross documents. Null text counts as empty; a repeated row counts as another document; a null
    doc_id is a document like any other. Other columns are ignored.
    """
    rows = repeats.keyed(df)
    index = rows.withColumn("ka", F.coalesce("id", F.lit((1 << 63) - 1)))
    ranges = repeats.covered_ranges(index, repeats.units_of_bytes, window, grams, interval_cover(window), F.col("n") > 1, "bytes")
    return repeats.apply_cover(rows, ranges, F.col("copied"), repeats.units_of_bytes, window, None, "bytes")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array_dedup(store.documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, octet_length(b) - 399)) AS i, b FROM d),
k AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS k FROM s),
t AS (SELECT doc_id, i FROM k JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
o AS (SELECT doc_id, i, CASE WHEN i > 400 + lag(i) OVER w OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, run),
b AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM r),
a AS (SELECT b.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, concat(string_agg(h[2 * before + 1:2 * lo], '' ORDER BY run), any_value(h[2 * last + 1:])) AS kept
  FROM b JOIN d USING (doc_id) JOIN (SELECT doc_id, max(hi) AS last FROM r GROUP BY doc_id) z USING (doc_id) GROUP BY b.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
