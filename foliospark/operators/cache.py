"""Keyed result caches and checkpoints: what is done, what is left, what may be computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """A string as JSON, other than ASCII kept as it is."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def cache_key(system: Column, user: Column, model: str, temperature: float, max_tokens: int) -> Column:
    """SHA-256 of the request as JSON with sorted keys."""
    parts = [F.lit(f'{{"max_tokens": {max_tokens}, "model": "{model}", "system": '), json_text(system), F.lit(f', "temperature": {temperature}, "user": '), json_text(user), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)


def resumed(chunks: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """chunks with the finished text of the same key, null where there is none (left join)."""
    return chunks.join(done.select(*key, F.col("text").alias("done_text")), list(key), "left")


def pending(chunks: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Chunks without a finished text that need one; bibliographies pass through untranslated."""
    return chunks.filter("kind <> 'bib'").join(done, list(key), "left_anti")


def incomplete(chunks: DataFrame, done: DataFrame, doc: str, order: str, shown: int = 24) -> DataFrame:
    """doc, n_missing and the first missing places of documents whose checkpoint lacks a chunk."""
    rest = chunks.join(done, [doc, order], "left_anti")
    return rest.groupBy(doc).agg(F.count(F.lit(1)).alias("n_missing"), F.slice(F.sort_array(F.collect_list(order)), 1, shown).alias("missing"))


def probed(requests: DataFrame, cache: DataFrame, mode: str) -> DataFrame:
    """requests(key, …) with the cached reply: off ignores the cache, record leaves misses null, replay fails on a miss."""
    if mode == "off":
        return requests.withColumn("reply", F.lit(None).cast("string"))
    out = requests.join(cache.select("key", "reply"), "key", "left")
    if mode == "replay":
        hit = F.col("reply").isNotNull()
        return out.withColumn("reply", F.when(hit, F.col("reply")).otherwise(F.raise_error(F.concat(F.lit("no cached reply for "), "key"))))
    return out


def translated(requests: DataFrame, cache: DataFrame, translate: Callable[[str], str], text: str = "text") -> DataFrame:
    """requests with a reply each: cached ones are reused, the others go through an injected function, in batches."""
    hit = probed(requests, cache, "record")

    def run(batches):
        for pdf in batches:
            pdf["reply"] = [r if r is not None else translate(t) for r, t in zip(pdf["reply"], pdf[text])]
            yield pdf

    return hit.mapInPandas(run, hit.schema)


def compiled(documents: DataFrame, cache: DataFrame, key: str = "sha256", files: DataFrame | None = None) -> DataFrame:
    """documents with the path of an earlier result: the same digest, successful; of several the last.

    With `files` (path), a listing of what is there, results whose file is gone do not count.
    """
    usable = cache.filter("success AND path IS NOT NULL")
    if files is not None:
        usable = usable.join(files.select("path").distinct(), "path", "left_semi")
    usable = usable.groupBy(key).agg(F.max_by("path", "written").alias("compiled_path"))
    return documents.join(usable, key, "left")
