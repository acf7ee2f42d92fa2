"""A training-data pipeline over `documents`: language, boilerplate lines, near-duplicates, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, language, line_dedup, mixing, near_dedup, store
from foliospark.sources.shared import few_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is like no learned language if its mean match is under this share of what unrelated symbols would have.
LEAST_MATCH = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language of the labelled ones, go; a missing lang is filled in.

    Where no row is labelled no language is learned, and only documents without a letter go.
    """
    store.arrow_batches(spark)
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs, model)
    clean = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("phrase_chars") >= LEAST_MATCH * model.chance))
    return clean.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites are cut out of the texts, whatever their share; texts of many sites are left to the next stage."""
    return few_files(line_dedup.line_dedup(docs, most=None).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at five words and 0.8, the document with the smallest doc_id stays, once; rows without one stay.

    Different texts under one doc_id are documents of their own, in order of their hashes.
    """
    store.arrow_batches(spark)
    text = F.coalesce("text", F.lit(""))
    named = docs.filter("doc_id IS NOT NULL").select(*COLUMNS, F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    own = ["doc_id", "h", "g"]
    if named.groupBy("doc_id").agg((F.min(F.struct("h", "g")) < F.max(F.struct("h", "g"))).alias("several")).filter("several").isEmpty():
        keyed = named.withColumn("key", F.col("doc_id"))
    else:
        numbers = store.save(store.numbered(named.select(*own).distinct(), list(map(F.col, own)), "near-order", "key"), "near-numbers")
        keyed = store.save(named.join(numbers.hint("merge"), own), "near-keyed")
    kept = near_dedup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("key")).distinct()
    first = keyed.join(kept.hint("merge"), "key").groupBy("key").agg(F.min(F.struct("text", "doc_id", "lang", "source", "n_chars")).alias("row"))
    return few_files(first.select("row.*").select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return few_files(mixing.mixed_documents(docs.select(*COLUMNS)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; what they decode to is compared with it."""
    import public_tokenizers

    store.arrow_batches(spark)
    both = bpe.recode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("bpe", tokens)]

#: Models, sketches and tokens are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each on what the one before it wrote."""
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
