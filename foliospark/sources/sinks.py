"""Writers: checkpoints, caches, reports, documents. Spark's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_finished(df: DataFrame, path: str, *key: str) -> None:
    """Add rows whose key is not in the table yet; asked twice, nothing changes."""
    spark = df.sparkSession
    try:
        there = spark.read.schema(df.schema).parquet(path)
        df = df.join(there.select(*key), list(key), "left_anti")
    except Exception as error:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written for each key of an appended table."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order).alias("r")).select("r.*")


def cache_results(df: DataFrame, path: str) -> None:
    """Replies as JSON in folders by the first two characters of their key."""
    df.withColumn("prefix", F.substring("key", 1, 2)).write.mode("append").partitionBy("prefix").json(path)


def report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def documents(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder for each document with its text."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def upsert_new(known: DataFrame, candidates: DataFrame, key: str, classes: list[str], most: int) -> DataFrame:
    """known and at most `most` candidates of allowed classes whose key it lacks, in order of the key."""
    fresh = candidates.filter(F.col("documentclass").isin(classes)).join(known.select(key), key, "left_anti").orderBy(key).limit(most)
    return known.unionByName(fresh.drop("documentclass"), allowMissingColumns=True)


def image_name(page: Column, index: Column, data: Column, extension: Column) -> Column:
    return F.concat(F.lit("img_p"), page.cast("string"), F.lit("_"), index.cast("string"), F.lit("_"), F.substring(F.md5(data), 1, 8), F.lit("."), extension)


def page_properties(authors: Column, abstract: Column, categories: Column) -> Column:
    """struct of what a knowledge-base page shows: ten authors and how many more, a cut abstract, five categories."""
    more = F.size(authors) - 10
    names = F.array_join(F.slice(authors, 1, 10), ", ")
    return F.struct(
        F.when(more > 0, F.concat(names, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(names).alias("authors"),
        F.when(F.length(abstract) > 2000, F.concat(F.substring(abstract, 1, 1997), F.lit("..."))).otherwise(abstract).alias("abstract"),
        F.slice(categories, 1, 5).alias("categories"),
    )


def storage(size: Column) -> Column:
    """The first service, by priority, that takes a file of a size; null beyond all (fixed limits)."""
    mb = 1024 * 1024
    return F.when(size <= 5 * mb, "direct").when(size <= 100 * mb, "file.io").when(size <= 512 * mb, "0x0").when(size <= 10 * 1024 * mb, "transfer")


#: What front ends take, in bytes (fixed limits): a direct upload, a chat message.
DIRECT_LIMIT, CHAT_LIMIT = 5 << 20, 8 << 20


def size_gate(size: Column, limit: int = CHAT_LIMIT) -> Column:
    """send, or list where the file is too large or its size unknown."""
    return F.when(size <= limit, "send").otherwise("list")


def missing_attachments(wanted: DataFrame, present: DataFrame, page: str, file: str) -> DataFrame:
    """Files of wanted(page, file, …) that the page has not yet, each once."""
    return wanted.dropDuplicates([page, file]).join(present.select(page, file), [page, file], "left_anti")


def block_ladder(direct: Column, permanent: Column, external: Column, name: Column) -> Column:
    """struct<way, value>: the first way of showing a file that worked, a note with its name else."""
    way = F.when(direct.isNotNull(), "direct").when(permanent.isNotNull(), "permanent").when(external.isNotNull(), "external").otherwise("note")
    return F.struct(way.alias("way"), F.coalesce(direct, permanent, external, F.concat(F.lit("PDF: "), name)).alias("value"))


def page_status(status: Column, error: Column) -> Column:
    """struct<status, error> of a page, the error cut to 2000 characters; null where there is none."""
    return F.struct(status.alias("status"), F.substring(error, 1, 2000).alias("error"))


def permanent_place(folder: str, paper: Column, kind: Column, file: Column, base: str | None = None) -> Column:
    """struct<path, url> of a kept file: folder/paper/kind_file, the url only with a base."""
    name = F.concat(paper, F.lit("/"), kind, F.lit("_"), file)
    url = F.concat(F.lit(f"{base.rstrip('/')}/"), name) if base else F.lit(None).cast("string")
    return F.struct(F.concat(F.lit(f"{folder.rstrip('/')}/"), name).alias("path"), url.alias("url"))


def debug_record(blocks: Column, text: int = 500, caption: int = 100) -> Column:
    """JSON of array<struct<kind, text>> for inspection: captions cut to 100 characters, other texts to 500."""
    cut = lambda b: F.struct(b["kind"].alias("kind"), F.when(b["kind"] == "caption", F.substring(b["text"], 1, caption)).otherwise(F.substring(b["text"], 1, text)).alias("text"))
    return F.to_json(F.transform(blocks, cut))


def log_line(ts: Column, level: Column, logger: Column, message: Column) -> Column:
    """The fixed format of a log, which sources.files reads again."""
    return F.concat_ws(" | ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), level, logger, message)


def installed_bbl(candidates: DataFrame, paper: str, stem: str) -> DataFrame:
    """paper, target, content: of candidates(paper, path, content) the longest that has entries, under the name that a run reads."""
    usable = candidates.filter(F.col("content").contains("\\bibitem"))
    best = usable.groupBy(paper).agg(F.max_by("content", F.struct(F.length("content"), "path")).alias("content"))
    return best.select(paper, F.lit(f"{stem}.bbl").alias("target"), "content")


def merged_report(batches: DataFrame, run: str) -> DataFrame:
    """run, payload: a run's batches(run, batch_index, start, count, passed, failed) with their totals as one JSON text."""
    fields = ["batch_index", "start", "count", "passed", "failed"]
    rows = batches.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("batches"), F.sum("passed").alias("total_passed"), F.sum("failed").alias("total_failed"))
    return rows.select(run, F.to_json(F.struct("batches", "total_passed", "total_failed")).alias("payload"))
