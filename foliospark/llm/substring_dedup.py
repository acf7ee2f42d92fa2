"""Removal of passages that an earlier document has, by prefix-partitioned suffix trees over words.

Suffixes are partitioned by their first words. Prefixes have variable lengths: a group of suffixes that is larger than
a task's share of memory, in bytes counted before anything moves, is split by a longer prefix (llm.repeats). Of each
group the suffix tree is built in preorder: its leaves in lexicographic order with the depth at which each parts from
the one before. Its internal nodes as deep as a window are the maximal repeats; a window is a repeat of an earlier
document if its node's least doc_id is smaller. Only suffixes that belong to a window's anchor name a group, and groups of a
single suffix are never gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import repeats, store, vectors

WINDOW = 50
#: Words that a group's prefix can have; the last resort is the whole window.
PREFIXES = (10, 25)


def _doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of twice as many symbols from the ranks of `step` symbols; past the end there is nothing, rank 0."""
    after = np.zeros_like(rank)
    after[:-step] = rank[step:]
    return np.unique(rank.astype(np.int64) << 32 | after, return_inverse=True)[1].astype(np.int32)


def subtree(symbols: np.ndarray, sizes: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree over strings of `sizes` symbols, in preorder, with the suffixes that begin at `leaves` (places in `symbols`).

    Returns the leaves in lexicographic order and the string depth at which each parts from the one before it (0 for
    the first): the depth of their lowest common ancestor. A string's end is a symbol that equals no other.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(symbols)) + owner  # an end after each string
    rank = np.zeros(len(symbols) + len(sizes) + 1, dtype=np.int32)
    rank[at] = np.unique(symbols, return_inverse=True)[1] + 1
    left = np.zeros(len(rank), dtype=np.int32)
    left[at] = (np.cumsum(sizes)[owner] - np.arange(len(symbols))).astype(np.int32)
    levels, step = [rank], 1
    while step < int(sizes.max(initial=0)):
        levels.append(_doubled(levels[-1], step))
        step *= 2
    order = leaves[np.argsort(levels[-1][at[leaves]], kind="stable")]
    a, b = at[order[:-1]], at[order[1:]]
    most, depth = np.minimum(left[a], left[b]), np.zeros(max(len(order) - 1, 0), dtype=np.int32)
    for level in reversed(levels):
        equal = level[np.minimum(a + depth, len(rank) - 1)] == level[np.minimum(b + depth, len(rank) - 1)]
        depth = np.where(equal & (depth < most), depth + step, depth)
        step //= 2
    return order, np.concatenate((np.zeros(min(len(order), 1), np.int32), np.minimum(depth, most)))


def deep_nodes(parting: np.ndarray, depth: int) -> np.ndarray:
    """Of each leaf, in order, the highest node at `depth` or deeper above it: an internal node if several leaves have it, else the leaf."""
    return np.cumsum(parting < depth) - 1


def tree_cover(window: int):
    def covered(ahead, many, data, ka):
        ((_, raw, starts, ends),) = vectors.batches(data, limit=1 << 62)
        values, _, first, last, _, _ = repeats.units_of_words(raw, starts, ends)
        owner, leaf = repeats._each(first, many)
        order, parting = subtree(values, last - first, leaf)
        node = np.empty(len(values), dtype=np.int64)
        node[order] = deep_nodes(parting, window)
        node = node[leaf]
        least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(least, node, ka[owner])
        later = np.flatnonzero(ka[owner] > least[node])
        if not len(later):
            return later, later, later
        row, inside = owner[later], leaf[later] - first[owner[later]]
        edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        return row[edge], inside[edge], inside[np.append(edge[1:], len(later)) - 1]

    return covered


def substring_dedup(df: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept (the rest, joined by one space, as bytes) for each row of `df` (doc_id, text).

    A word goes if it is in a window of `window` words that also starts in a document with a smaller doc_id. Null text
    has no words; texts shorter than a window keep all. A null doc_id is smaller than none and larger than none: its row
    is kept whole and removes nothing. Rows that share a doc_id do not remove each other's words. Other columns are ignored.
    """
    rows = repeats.keyed(df)
    index = rows.filter("id IS NOT NULL").withColumn("ka", F.col("id"))
    ranges = repeats.covered_ranges(index, repeats.units_of_words, window, prefixes, tree_cover(window), F.col("least") < F.col("ka"), "substrings")
    return repeats.apply_cover(rows, ranges, F.col("id") > F.col("least"), repeats.units_of_words, window, b" ", "substrings", F.col("id").isNull())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(store.documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM s),
h AS (SELECT k.doc_id, i FROM k JOIN (SELECT k, min(doc_id) AS first FROM k GROUP BY k) m USING (k) WHERE first < k.doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
c AS (SELECT e.doc_id, word, j, coalesce(j - h.i <= 49, false) AS gone FROM e ASOF LEFT JOIN h ON h.doc_id = e.doc_id AND h.i <= e.j),
p AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept FROM p GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM w LEFT JOIN a USING (doc_id)
"""
