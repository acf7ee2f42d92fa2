"""Exact deduplication with keyed streaming state.

Documents arrive as a stream. The state (RocksDB, on disk, no expiry) keeps for each digest of the normalised text the
smallest stable identifier seen, the number of rows and the locator (file and row) of that document's content. Rows
whose digest was seen are hits: their full bytes are compared with the located content, so a digest collision never
merges different texts. Only DataFrame and SQL functions run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import store

#: State on disk; changes, not whole snapshots, are written to the checkpoint, and small stores reserve no space ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), store.SPACE, " ")


def sha(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _with_place(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return (
        df.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        .withColumn("digest", digest(F.col("norm")))
    )


def keyed_state(spark: SparkSession, path: str, schema, digest: Callable[[Column], Column] = sha, files_per_batch: int = 4096, state: str | None = None) -> DataFrame:
    """Run the stream over the files of `path`; returns one row a digest: digest, n, keep(no_id, doc_id, file, row).

    `state` is the shared folder that holds the stream's checkpoint with its keyed state, and the changes. A later run
    with the same folder reads only files that are new in `path`; without one the state ends with the application.
    """
    out, points = (f"{state.rstrip('/')}/{part}" for part in ("changes", "stream")) if state else (store.new_path(spark, "dedup-state"), store.new_path(spark, "dedup-stream"))
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that a table of one file streams as well as a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    keyed = _with_place(stream, digest).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keep"),
    )
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        # A batch that is tried again overwrites its own folder, so each change counts once.
        query = (
            keyed.writeStream.outputMode("update")
            .foreachBatch(lambda changed, k: changed.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/changes={k}"))
            .option("checkpointLocation", points)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    shape = f"digest {dict(keyed.dtypes)['digest']}, n long, keep {dict(keyed.dtypes)['keep']}, batch long"
    changes = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(out) if _exists(spark, out) else spark.createDataFrame([], shape)
    # Counts only grow and the smallest identifier only falls, so the last state of a digest is its extremes.
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.min("keep").alias("keep"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha, files_per_batch: int = 4096, state: str | None = None) -> DataFrame:
    """One row for each row of the table at `path` (columns doc_id, text, any others): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and equals other empty texts. A null doc_id is larger than every other; of rows that
    share the smallest doc_id, the first in file order is kept, so one row of each group is. An empty table gives no
    rows. Columns beside doc_id and text are ignored, whatever their names. With a `state` folder only files that
    earlier runs have not seen go through the stream; the result is that of all files.
    """
    docs = spark.read.parquet(path).select("doc_id", "text")
    groups = store.save(keyed_state(spark, path, docs.schema, digest, files_per_batch, state), "dedup-groups")
    rows = _with_place(spark.read.parquet(path), digest)
    hit = groups.filter("n > 1")
    n_hit = hit.count()
    located = hit.select(F.col("digest").alias("d"), F.col("keep.file").alias("file"), F.col("keep.row").alias("row"))
    first = rows.join(store.small(located, n_hit, 400), ["file", "row"]).select("d", F.col("norm").alias("keep_norm"))
    members = rows.join(store.small(hit.select("digest"), n_hit, 160), "digest", "left_semi")
    differs = store.save(
        members.join(first.hint("merge"), F.col("digest") == F.col("d")).filter(F.col("norm") != F.col("keep_norm")).select("doc_id", "file", "row", "digest", "norm"),
        "dedup-collisions",
    )
    narrow = rows.select("doc_id", "file", "row", "digest", F.sha2("norm", 256).alias("text_sha256"))
    joined = narrow.join(groups, "digest")
    if differs.isEmpty():
        return joined.select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
            ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))).alias("kept"), "text_sha256",
        )
    # Digest collisions: rows unlike the located content form groups of their own by their full text.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    own = differs.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n2"), F.min(place).alias("keep2"))
    moved = differs.join(own, ["digest", "norm"]).select("file", "row", "n2", "keep2")
    gone = differs.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    fixed = joined.join(gone, "digest", "left").join(moved, ["file", "row"], "left")
    keep = F.coalesce("keep2", "keep")
    return fixed.select(
        "doc_id", keep["doc_id"].alias("keep_id"), F.coalesce("n2", F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        ((keep["file"] == F.col("file")) & (keep["row"] == F.col("row"))).alias("kept"), "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
