"""The folder that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local session gets a private one; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/foliospark/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Rows of a few numbers from which a table has a file more than one a core.
FILE_ROWS = 1 << 17


def few_files(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in at most an eighth of the shuffle partitions, or four a core where that is more; whole partitions are joined, no row is dealt anew.
    `rows`: about how many narrow rows it has, where that is known; few of them go to one file a core.

    Every file that an executor writes to a local folder starts about three processes (Hadoop's chmod), which take longer than a small
    file's rows and count with the executor's whole memory until they run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    return df.coalesce(most if rows is None else min(most, max(cores, -(-rows // FILE_ROWS))))
