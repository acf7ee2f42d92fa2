"""Runs as rows: what is consumed in order of completion, what a budget allows, what times out and is tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def until_first_failure(df: DataFrame, run: str, order: list[str], failed: Column) -> DataFrame:
    """Rows of each run in order of completion up to its first failure, that one included: what came after is not consumed."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_failed", failed.cast("int")).withColumn("_before", F.coalesce(F.max("_failed").over(before), F.lit(0))).filter("_before = 0").drop("_failed", "_before")


def within_budget(df: DataFrame, run: str, order: list[str], seconds: Column, budget: float) -> DataFrame:
    """Passes of each run that start before its budget is spent; a pass that has begun ends."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_spent", F.coalesce(F.sum(seconds).over(before), F.lit(0.0))).filter(F.col("_spent") < budget).drop("_spent")


def timed(seconds: Column, limit: float, code: Column, log: Column, tail: int = 300) -> Column:
    """struct<code, tail> of a case: 124 and the log's last characters where it took longer than the limit."""
    late = seconds > limit
    return F.struct(F.when(late, 124).otherwise(code).alias("code"), F.when(late, F.right(log, F.lit(tail))).alias("tail"))


def retry_pass(seconds: Column, limit: float, factor: float = 2.0, passes: int = 2) -> Column:
    """The pass, from 0, in which a case ends within limit * factor**pass; null if it does in none of them."""
    out = F.lit(None).cast("int")
    for k in reversed(range(passes + 1)):
        out = F.when(seconds <= limit * factor**k, k).otherwise(out)
    return out
