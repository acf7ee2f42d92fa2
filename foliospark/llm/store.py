"""Tables written to the folder that all executors share, and what every operator asks of its session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.shared import few_files, new_path

#: Rows times row bytes up to which a table whose size was counted may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20

#: What separates words in every contract of this package (fixed value).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def save(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as a shared table and return a scan of it: lineage ends there, and lost executors cost nothing. `rows` as for few_files()."""
    spark = df.sparkSession
    path = new_path(spark, label)
    few_files(df, rows).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliospark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by save() that nothing reads any more."""
    spark, path = df.sparkSession, df._foliospark_path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is under the bound, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, label: str, name: str = "row_no") -> DataFrame:
    """df (narrow columns) with gapless global row numbers from 0 in the given order.

    Range partitions are sorted and written once; a row's number is its place in its partition plus the rows of the
    partitions before it. Only one count per partition passes through a single task. `order` must be total up to
    identical rows.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(partitions(spark), 1), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    table = save(ranged.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1))), label)
    counts = sorted((r[0], r[1]) for r in table.groupBy("_part").count().collect())  # one row a partition
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return table.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_place") + F.col("_start")).drop("_part", "_place", "_start")


#: Rows and bytes of an Arrow batch between Spark and Python: long texts come in batches of few.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def arrow_batches(spark: SparkSession) -> None:
    """Where the session has Spark's own Arrow batch sizes, set smaller ones for whole texts."""
    for key, (default, ours) in ARROW.items():
        if spark.conf.get(key, default).lower().rstrip("b") in (default, "64m"):
            spark.conf.set(key, ours)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, in a session that has small Arrow batches."""
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What operators keep in a worker from task to task, by name.
KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What a worker keeps for the operator `name`; what it has kept for others goes, so that a reused worker holds one operator's tables only."""
    for other in [k for k in KEPT if k != name and KEPT[k]]:
        del KEPT[other]
        trim()
    return KEPT.setdefault(name, {})


def trim() -> None:
    """Give memory that is free in this process back to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
