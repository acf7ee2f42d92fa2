"""Cross-site boilerplate lines, by how many distinct sites a line has.

Each line hash has a HyperLogLog sketch of its sites; sketches merge by aggregation, before the shuffle and after it.
Lines whose estimate is near the threshold get an exact distinct count. Lines on enough sites are removed, whatever
their share of a document. Only a text that is itself on enough sites is a copy, not boilerplate: it keeps the lines
that no other texts spread as far, for document deduplication to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import store

MIN_SITES = 8
#: log2 of the sketch's registers, and how far off, relative to the threshold, an estimate counts as near (six standard errors).
LG_K = 11
NEAR = 0.15


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _plain(line: Column) -> Column:
    """What makes lines equal: white space trimmed, runs of it as one space."""
    return F.trim(F.regexp_replace(line, store.SPACE, " "))


def spread_lines(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """k1, k2 of the lines in rows(k1, k2, site) that at least `min_sites` distinct sites have."""
    sketched = rows.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    wide = sketched.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR) - 1)
    wide = store.save(wide, "lines-wide")
    is_near = F.col("sites") <= min_sites * (1 + NEAR) + 1
    near = wide.filter(is_near)
    exact = rows.join(store.small(near.select("k1", "k2"), near.count(), 32), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count_distinct("site").alias("n"))
    return wide.filter(~is_near).select("k1", "k2").unionByName(exact.filter(F.col("n") >= min_sites).select("k1", "k2"))


def _spread_by_others(hits: DataFrame, min_sites: int) -> DataFrame:
    """hits(k1, k2, site, _h, _g, any others) without lines of texts on `min_sites` sites that other texts do not spread as far."""
    hits = store.save(hits, "lines-hits")
    copied = store.save(spread_lines(hits.select(F.col("_h").alias("k1"), F.col("_g").alias("k2"), "site"), min_sites), "lines-copied")
    copied = store.small(copied.select(F.col("k1").alias("_h"), F.col("k2").alias("_g")), copied.count(), 32)
    others = hits.join(copied, ["_h", "_g"], "left_anti")
    wide = store.save(spread_lines(others.select("k1", "k2", "site"), min_sites), "lines-others")
    still = hits.join(copied, ["_h", "_g"], "left_semi").join(store.small(wide, wide.count(), 32), ["k1", "k2"], "left_semi")
    return others.unionByName(still.select(others.columns))


def line_dedup(df: DataFrame, min_sites: int = MIN_SITES, most: float | None = None) -> DataFrame:
    """df (doc_id, text, source, any others) with boilerplate lines cut out of `text`, and n_lines, n_removed.

    Lines end at line feeds; blank lines are never boilerplate. A null source is a site of its own. Null text has no
    lines and stays null; empty text has one. Rows of the same doc_id and text are treated alike. Columns named n_lines or
    n_removed are replaced. A text that is itself on `min_sites` sites keeps the lines that no other texts spread to as
    many: its copies have made them boilerplate. With `most` no text is a copy for that reason, but a document more than
    `most` of whose line characters are boilerplate keeps all.
    """
    df = df.drop("n_lines", "n_removed")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_h")]
    if most is None:
        key.append(F.xxhash64(F.lit(1), text).alias("_g"))
    each = df.select(*key, F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\u0000"))).alias("site"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    named = each.withColumn("plain", _plain(F.col("line"))).filter("plain <> ''").select(*each.columns[: len(key)], "site", "at", F.length("line").alias("size"), F.xxhash64("plain").alias("k1"), F.xxhash64(F.lit(1), "plain").alias("k2"))
    wide = store.save(spread_lines(named.select("k1", "k2", "site"), min_sites), "lines-spread")
    hits = named.join(store.small(wide, wide.count(), 32), ["k1", "k2"], "left_semi").distinct()
    if most is None:
        hits = _spread_by_others(hits, min_sites)
    cut = store.save(hits.groupBy("_id", "_h").agg(F.collect_set("at").alias("gone"), F.sum("size").alias("gone_size")), "lines-cut")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"))
    joined = row.join(cut.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    given = F.col("row.text")
    lines = _lines(given)
    whole = F.length(F.replace(given, F.lit("\n"), F.lit("")))
    applies = F.col("gone").isNotNull() & (F.lit(True) if most is None else F.col("gone_size") <= whole * F.lit(most))
    # The places that stay by a set difference, then the lines there: linear in long documents too.
    kept = F.element_at(F.transform(F.array(lines), lambda each: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col("gone")), lambda i: F.get(each, i)), "\n")), 1)
    return joined.select(
        F.col("row").withField("text", F.when(applies, kept).otherwise(given)).alias("row"),
        F.when(given.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(applies, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
    ).select("row.*", "n_lines", "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(store.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH e AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
n AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM e),
w AS (SELECT plain FROM n WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT coalesce(source, chr(0))) >= 8),
c AS (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT coalesce(source, chr(0))) >= 8),
o AS (SELECT plain FROM n WHERE plain <> '' AND text NOT IN (SELECT text FROM c WHERE text IS NOT NULL) GROUP BY plain HAVING count(DISTINCT coalesce(source, chr(0))) >= 8),
m AS (SELECT n.*, w.plain IS NOT NULL AND (c.text IS NULL OR o.plain IS NOT NULL) AS hit FROM n LEFT JOIN w USING (plain) LEFT JOIN c ON c.text = n.text LEFT JOIN o ON o.plain = n.plain),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS hits, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit) AS rest FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(hits, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN hits > 0 THEN coalesce(rest, '') ELSE coalesce(t.text, '') END) AS kept_sha256
FROM documents t LEFT JOIN d USING (doc_id)
"""
