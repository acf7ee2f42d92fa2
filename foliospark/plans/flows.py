"""Writers, readers and streams as queries: what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import report
from foliospark.plans.catalog import query, table
from foliospark.sources import files, sinks
from foliospark.sources.shared import new_path
from foliospark.streaming import progress


def _stream(spark, d, name):
    """A table as a stream; as a pattern, so that a table of one file streams as well as a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("z01_k01_resumable_progress", "SELECT conv_id, count(*) AS done, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def resumable_progress(spark, d):
    out, points = new_path(spark, "progress"), new_path(spark, "points")
    for _ in range(2):  # started again, nothing is done twice
        progress.resumable(_stream(spark, d, "conversations"), lambda df: df.withColumn("size", F.length("text")), out, points).awaitTermination()
    rows = spark.read.parquet(out).groupBy("conv_id").agg(F.count(F.lit(1)).alias("done"), F.sum("size").cast("long").alias("chars"), F.count_if(F.col("role") == "user").alias("asked"))
    return rows


@query("z06_first_seen", "SELECT user_id, 1 AS times FROM events GROUP BY user_id")
def first_seen(spark, d):
    out, points = new_path(spark, "seen"), new_path(spark, "points")
    rows = progress.first_seen(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "60 days").select("user_id")
    progress.resumable(rows, lambda df: df, out, points).awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("times"))


@query("z07_answered_stream", "SELECT c.conv_id, count(*) AS asked, count(o.o_orderkey) AS answered FROM conversations c LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) o ON o.o_orderkey = c.conv_id GROUP BY c.conv_id")
def answered_stream(spark, d):
    out, points = new_path(spark, "answered"), new_path(spark, "points")
    cache = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.lit("r").alias("reply"))
    asked = _stream(spark, d, "conversations").select(F.col("conv_id").alias("key"))
    progress.resumable(progress.answered(asked, cache), lambda df: df, out, points).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("key").alias("conv_id")).agg(F.count(F.lit(1)).alias("asked"), F.count("reply").alias("answered"))


@query("k02_s11_cache_round_trip", "SELECT sha256(doc_id::VARCHAR) AS key, text AS translated_content, length(text) // 4 AS input_tokens FROM documents")
def cache_round_trip(spark, d):
    path = new_path(spark, "replies")
    rows = table(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("text").alias("translated_content"), F.floor(F.length("text") / 4).alias("input_tokens"))
    sinks.cache_results(rows, path)
    return spark.read.schema("key string, translated_content string, input_tokens bigint").json(path).select("key", "translated_content", "input_tokens")


@query("k01_s10_finished_once", "SELECT conv_id, turn, upper(role) AS text FROM conversations")
def finished_once(spark, d):
    path = new_path(spark, "finished")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.upper("role").alias("text"))
    sinks.append_finished(rows.filter("turn % 2 = 0"), path, "conv_id", "turn")
    sinks.append_finished(rows, path, "conv_id", "turn")
    return spark.read.parquet(path)


@query("s12_s28_s29_reports", "SELECT o_custkey % 20 AS batch, count(*) FILTER (o_orderkey % 7 <> 0) AS passed, count(*) FILTER (o_orderkey % 7 = 0) AS failed, count(*) FILTER (o_orderkey % 21 = 0) AS timeouts FROM orders GROUP BY 1")
def reports(spark, d):
    path = new_path(spark, "reports")
    k = F.col("o_orderkey")
    reason = F.when(k % 21 == 0, "cli_failed_rc=124 x").when(k % 7 == 0, "missing_file: a")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("batch"), (k % 7 != 0).alias("ok"), F.struct(k.cast("string").alias("arxiv_id"), F.filter(F.array(reason), lambda x: x.isNotNull()).alias("reasons")).alias("r"))
    whole = report.totals(rows, "batch").join(rows.groupBy("batch").agg(F.collect_list("r").alias("results")), "batch")
    report_rows = whole.select("batch", "passed", "failed", "results")
    sinks.report_json(report_rows, path)
    read = spark.read.schema("batch bigint, passed bigint, failed bigint, results array<struct<arxiv_id: string, reasons: array<string>>>").json(path)
    late = files.timed_out(read).withColumn("late", F.lit(1))
    each = read.select("batch", "passed", "failed", F.explode("results").alias("r")).join(late, F.col("r.arxiv_id") == F.col("arxiv_id"), "left")
    return each.groupBy("batch", "passed", "failed").agg(F.count("late").alias("timeouts"))


@query("k12_k16_k21_properties", r"""SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(left(text, 1997), '...') ELSE text END AS abstract, concat('img_p', (doc_id % 9)::VARCHAR, '_0_', left(md5(text), 8), '.png') AS image,
 CASE WHEN n_chars * 100000 <= 5242880 THEN 'direct' WHEN n_chars * 100000 <= 104857600 THEN 'file.io' WHEN n_chars * 100000 <= 536870912 THEN '0x0' WHEN n_chars * 100000 <= 10737418240 THEN 'transfer' END AS service FROM documents""")
def properties(spark, d):
    shown = sinks.page_properties(F.array(F.col("source")), F.col("text"), F.array(F.col("lang")))
    image = sinks.image_name(F.col("doc_id") % 9, F.lit(0), F.col("text"), F.lit("png"))
    return table(spark, d, "documents").select("doc_id", shown["abstract"].alias("abstract"), image.alias("image"), sinks.storage(F.col("n_chars") * 100000).alias("service"))


@query("s03_s07_main_files", r"""SELECT doc_id::VARCHAR AS archive, CASE doc_id % 3 WHEN 0 THEN 'main.tex' WHEN 1 THEN 'z.tex' ELSE 'a.tex' END AS member, sha256(CASE doc_id % 3 WHEN 0 THEN concat('\documentclass{a} ', text) ELSE concat('\documentclass{b} ', text) END) AS text_sha FROM documents""")
def main_files(spark, d):
    k = F.col("doc_id") % 3
    key = F.col("doc_id").cast("string").alias("archive")
    docs = table(spark, d, "documents")
    main = docs.select(key, F.when(k == 0, "main.tex").when(k == 1, "z.tex").otherwise("a.tex").alias("member"), F.when(k == 0, "\\documentclass{a} \\input{part}").otherwise("\\documentclass{b} \\input{part.tex}").alias("text"))
    other = docs.select(key, F.lit("b/other.tex").alias("member"), F.lit("\\documentclass{c}").alias("text"))
    part = docs.select(key, F.lit("part.tex").alias("member"), F.col("text"))
    all_files = main.unionByName(other).unionByName(part)
    elected = files.main_files(all_files)
    flat = files.flattened(all_files, elected).select("archive", F.sha2("text", 256).alias("text_sha"))
    return elected.join(flat, "archive")
