"""Which texts hold which probes as substrings, without comparing every text with every probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a gram by which a probe is looked up, and code points by which a word is.
GRAM, PIECE = 4, 3


def _words(text: Column) -> Column:
    return F.split(text, r"\s+", -1)


def _grams(words: Column, size: Column) -> Column:
    """Hashes of the different runs of `size` words."""
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _pieces(word: Column, size: Column) -> Column:
    """The different runs of `size` code points of a word."""
    return F.when(F.length(word) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(word, i, size)))).otherwise(F.array().cast("array<string>"))


def _sized(parts: Column, size: int, name: str) -> Column:
    return F.transform(parts, lambda x: F.struct(F.lit(size).alias("_size"), x.alias(name)))


def contained(texts: DataFrame, key: str, text: str, probes: DataFrame, probe_key: str, probe: str) -> DataFrame:
    """key, probe_key of every text that holds a probe as a substring; empty and null probes are in none.

    The words of a probe but for its first and last are whole words of a text that holds it, so a probe of three words
    or more is looked up by a gram of these, the one that the fewest texts have. A shorter one is looked up by its
    longest word, which is part of a word of the text: among the different words of all texts, by runs of three code
    points. Both give pairs of keys; the test for the whole probe, for which each text moves once a pair, settles the rest.
    """
    asked = probes.select(F.col(probe_key).alias("_id"), F.col(probe).alias("_probe")).filter("_probe <> ''").withColumn("_w", _words(F.col("_probe")))
    long = asked.filter(F.size("_w") >= 3).withColumn("_w", F.slice("_w", F.lit(2), F.size("_w") - 2)).withColumn("_size", F.least(F.size("_w"), F.lit(GRAM)))
    sizes = sorted(r[0] for r in long.select("_size").distinct().collect())  # GRAM of them at most
    words = texts.select(F.col(key).alias("_key"), _words(F.col(text)).alias("_w"))

    short = asked.filter(F.size("_w") < 3).withColumn("_word", F.element_at(F.array_sort(F.col("_w"), lambda a, b: F.length(b) - F.length(a)), 1)).filter("_word <> ''")
    short = short.withColumn("_size", F.least(F.length("_word"), F.lit(PIECE))).withColumn("_piece", F.expr("substring(_word, 1, _size)"))
    each = words.select("_key", F.explode(F.array_distinct("_w")).alias("_own")).filter("_own <> ''")
    cut = F.flatten(F.array(*[_sized(_pieces(F.col("_own"), F.lit(n)), n, "_piece") for n in range(1, PIECE + 1)]))
    vocabulary = each.select("_own").distinct().select("_own", F.explode(cut).alias("p")).select("_own", "p._size", "p._piece")
    having = vocabulary.join(short.select("_id", "_word", "_size", "_piece"), ["_size", "_piece"]).filter(F.col("_own").contains(F.col("_word"))).select("_own", "_id").distinct()
    pairs = each.join(having, "_own").select("_key", "_id").distinct()
    if sizes:
        own = long.select("_id", "_size", F.explode(_grams(F.col("_w"), F.col("_size"))).alias("_gram"))
        runs = F.flatten(F.array(*[_sized(_grams(F.col("_w"), F.lit(n)), n, "_gram") for n in sizes]))
        grams = words.select("_key", F.explode(runs).alias("g")).select("_key", "g._size", "g._gram")
        known = grams.join(own.select("_size", "_gram").distinct(), ["_size", "_gram"], "left_semi")
        often = known.groupBy("_size", "_gram").agg(F.count(F.lit(1)).alias("_n"))
        # A gram that no text has rules its probe out; of the others the rarest is enough.
        rarest = own.join(often, ["_size", "_gram"], "left").groupBy("_id", "_size").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("r")).filter("r.n > 0")
        pairs = pairs.unionByName(known.join(rarest.select("_id", "_size", F.col("r._gram").alias("_gram")), ["_size", "_gram"]).select("_key", "_id"))
    hits = pairs.join(asked.select("_id", "_probe"), "_id").join(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key")
    return hits.filter(F.col("_text").contains(F.col("_probe"))).select(F.col("_key").alias(key), F.col("_id").alias(probe_key)).distinct()
