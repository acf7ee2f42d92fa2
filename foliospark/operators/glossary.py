"""Glossary terms: reading, choosing a language, finding the terms of a document, formats and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

#: Glossaries up to so many bytes (three a character, and 64 a row) are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def small(rows: DataFrame) -> DataFrame:
    """rows of strings with a broadcast hint if they were measured to be under the bound."""
    size = rows.agg(F.sum(F.lit(64) + sum((F.coalesce(F.length(c), F.lit(0)) for c in rows.columns), F.lit(0)) * 3)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def chosen(glossary: DataFrame, lang: str) -> DataFrame:
    """glossary(term, lang, translation; a null lang is a plain string) -> term, translation for one language.

    Plain strings are Russian. Of several spellings the exact code wins, then the part before a hyphen, then before an underscore.
    """
    code = F.lower(F.trim(F.lit(lang)))
    want = T.mapped(code, T.LANGUAGE_ALIASES, code)
    order = F.when(F.col("lang").isNull() & (want == "ru"), 0).when(F.col("lang") == want, 0).when(F.col("lang") == F.split(want, "-")[0], 1).when(F.col("lang") == F.split(want, "_")[0], 2)
    rows = glossary.withColumn("lang", F.lower(F.trim("lang"))).withColumn("o", order).filter("o IS NOT NULL")
    return rows.groupBy("term").agg(F.min_by("translation", "o").alias("translation"))


def bounded(term: Column) -> Column:
    """A term as a pattern between word boundaries."""
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)"))


def relevant_terms(docs: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """key, term: the glossary terms (lower case) that occur in a document between word boundaries.

    Each document's distinct words meet the terms' first words in an equi-join, so the work follows the text and not
    text times glossary; the term itself and its boundaries settle the rest. A term without a word is found nowhere.
    """
    words = lambda t: F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0))
    terms = glossary.select(F.lower("term").alias("term")).distinct().withColumn("word", F.get(words(F.col("term")), F.lit(0))).filter("word IS NOT NULL")
    terms = small(terms)
    doc = docs.select(F.col(key), F.lower(text).alias("low"))
    hits = doc.select(key, "low", F.explode(F.array_distinct(words(F.col("low")))).alias("word")).join(terms, "word")
    return hits.filter(F.col("low").contains(F.col("term")) & F.rlike("low", bounded(F.col("term")))).select(key, "term").distinct()


def compact(pairs: Column) -> Column:
    """map<term, translation> as JSON without spaces, terms in order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(pairs))))


def listed(pairs: Column) -> Column:
    lines = F.transform(F.sort_array(F.map_entries(pairs)), lambda e: F.concat(F.lit("  \u2022 "), e["key"], F.lit(" \u2192 "), e["value"]))
    return F.when(F.size(pairs) == 0, F.lit("\u0413\u043b\u043e\u0441\u0441\u0430\u0440\u0438\u0439 \u043f\u0443\u0441\u0442.")).otherwise(F.array_join(lines, "\n"))


def token_cost(formatted: Column, terms: Column) -> Column:
    return F.when(terms == 0, 0).otherwise(F.greatest(F.floor(F.length(formatted) / 4), F.lit(1))).cast("long")


def usage(docs: DataFrame, glossary: DataFrame, key: str, text: str, lang: str = "ru") -> DataFrame:
    """key and total_terms, relevant_terms, usage_percentage, full_tokens, relevant_tokens, tokens_saved for every document."""
    plain = chosen(glossary, lang)
    # The whole glossary as JSON is not made: its length is that of its pairs, each alone, with commas between and braces around.
    pair = F.length(F.to_json(F.create_map("term", "translation"))) - 2
    full = plain.agg(F.coalesce(F.sum(pair + 1) + 1, F.lit(2)).alias("size"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.floor(F.col("size") / 4), F.lit(1))).cast("long").alias("full_tokens"))
    total = glossary.select("term").distinct().agg(F.count(F.lit(1)).alias("total_terms"))
    found = relevant_terms(docs, glossary, key, text)
    own = found.join(small(plain), "term", "left").groupBy(key).agg(F.count(F.lit(1)).alias("relevant_terms"), F.map_from_entries(F.filter(F.collect_list(F.struct("term", "translation")), lambda e: e["translation"].isNotNull())).alias("m"))
    rows = docs.select(key).join(own, key, "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(full))
    rel = F.coalesce("relevant_terms", F.lit(0))
    tokens = F.when(F.col("m").isNull(), 0).otherwise(token_cost(compact(F.col("m")), F.size("m"))).cast("long")
    return rows.select(key, "total_terms", rel.alias("relevant_terms"), F.round(rel * 100.0 / F.col("total_terms"), 1).alias("usage_percentage"), "full_tokens", tokens.alias("relevant_tokens"), (F.col("full_tokens") - tokens).alias("tokens_saved"))
