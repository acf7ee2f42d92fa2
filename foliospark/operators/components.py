"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.shared import few_files, new_path

#: Steps after which components that still change are an error; their number grows with the logarithm of the longest path.
MOST_STEPS = 100


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (the least node reachable) for the nodes of edges(a, b), longs.

    Each step links nodes to the least neighbour; neighbour lists are never gathered, only their minimum is, which is
    combined before the shuffle, so a node with very many links is no task of its own. Each step is written to the
    shared folder and read again, so its lineage ends there.
    """
    now = _saved(_oriented(edges), f"{label}-0")
    before = None
    rows = now.count()
    for k in range(1, MOST_STEPS + 1):
        old, now = now, _saved(_small_star(_large_star(now)), f"{label}-{k}", rows)
        _deleted(old)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {MOST_STEPS} steps")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).groupBy("node").agg(F.min("root").alias("root"))


def _saved(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    path = new_path(df.sparkSession, label)
    few_files(df, rows).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliospark_path = path
    return out


def _deleted(df: DataFrame) -> None:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._foliospark_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger end first, once each, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(linked.unionByName(least.select("a", F.col("m").alias("b"))))
