"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by doc_id; the number is sent through a keyed Feistel network on a square domain just above the row
count, again and again while it falls outside (cycle walking), which permutes 0..n-1. The shard is the permuted number
modulo the shard count and the slot its quotient: both can be computed for any row, or inverted, without the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import store

#: Multiplier and addends of the round function (fixed values, any odd numbers under 2**31 would do).
FACTOR = 1103515245
ROUND_KEYS = (12345, 40503, 69069, 9973)


def half_size(rows: int) -> int:
    """Side of the square domain: the least h with h * h >= rows."""
    side = int(np.sqrt(rows))
    while side * side < rows:
        side += 1
    return max(side, 1)


def _mix(value, key: int, seed: int):
    """Round function on numbers under 2**31, in 64-bit arithmetic that SQL engines share."""
    low = (value * FACTOR + key * (2 * seed + 1)) % 2147483647
    return (low * 48271 + low // 65536) % 2147483647


def permute(numbers, rows: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """Image of row numbers 0..rows-1 under the permutation for (rows, seed); `inverse` undoes it."""
    side = half_size(rows)
    out = np.array(numbers, dtype=np.int64)
    left = np.ones(len(out), dtype=bool)
    while left.any():
        a, b = np.divmod(out[left], side)
        for key in ROUND_KEYS[::-1] if inverse else ROUND_KEYS:
            a, b = ((b - _mix(a, key, seed)) % side, a) if inverse else (b, (a + _mix(b, key, seed)) % side)
        out[left] = a * side + b
        left = out >= rows
    return out


def feistel_shards(df: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard, slot for each row of `df` (doc_id, text, any others, which are ignored).

    Row counts of shards differ by one at most and slots are gapless from 0. Rows are numbered by doc_id (null first),
    then CRC-32 and size, so repeated rows get neighbouring numbers and results do not depend on file order. Null
    text counts as empty. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = df.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = store.numbered(narrow, ["doc_id", "text_crc32", "size"], "shard-rows")
    rows = numbered.count()

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at = permute(batch.column("row_no").to_numpy(zero_copy_only=False), rows, seed)
            table = pa.Table.from_batches([batch]).append_column("shard", pa.array((at % shards).astype(np.int32))).append_column("slot", pa.array(at // shards))
            yield from table.to_batches()

    return numbered.mapInArrow(place, f"doc_id {dict(df.dtypes)['doc_id']}, size long, text_crc32 long, row_no long, shard int, slot long")


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(store.documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )


def _sql() -> str:
    """The same permutation as a recursive walk; CRC-32 by its table, byte by byte."""
    mix = lambda v, key: f"((({v} * {FACTOR} + {key}) % 2147483647) * 48271 + (({v} * {FACTOR} + {key}) % 2147483647) // 65536) % 2147483647"
    steps = "SELECT rn, n, side, step, x // side AS a0, x % side AS b0 FROM walk WHERE step = 0 OR x >= n"
    for k, key in enumerate(ROUND_KEYS):
        steps = f"SELECT rn, n, side, step, b{k} AS a{k + 1}, (a{k} + {mix(f'b{k}', key)}) % side AS b{k + 1} FROM ({steps})"
    return rf"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(256))::BIGINT AS n)),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT doc_id, octet_length(b) + 1 AS size,
  xor(4294967295, list_reduce(list_transform(range(0, octet_length(b)), lambda i: concat('0x', hex(b[i + 1:i + 1]))::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a // 256), 4294967295::BIGINT)) AS text_crc32 FROM d, crc_table),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn, count(*) OVER () AS n FROM c),
walk(rn, n, side, step, x) AS (SELECT rn, n, ceil(sqrt(n))::BIGINT, 0, rn FROM k UNION ALL SELECT rn, n, side, step + 1, a{len(ROUND_KEYS)} * side + b{len(ROUND_KEYS)} FROM ({steps})),
f AS (SELECT rn, arg_max(x, step) AS x FROM walk GROUP BY rn)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % 16)::INT AS shard, x // 16 AS slot, NULL::INT AS grown_shard, rn AS row_no FROM k JOIN f USING (rn)
"""


SQL = _sql()
