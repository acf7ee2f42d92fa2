"""State-like behaviour as structured streams: resumable work, new items, counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, points: str) -> StreamingQuery:
    """Run `work` on each batch of a stream and write its rows; stopped and started again, it goes on where it was.

    A batch that is repeated overwrites its own folder, so every row is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", points).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def answered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """A stream of requests(key) with the cached reply of each, null on a miss (stream-static join)."""
    return requests.join(cache.select("key", "reply"), "key", "left")


def counts(stream: DataFrame, time: str, *by: str, window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """start, by, n over tumbling or sliding windows; late rows count until the watermark has passed."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, window, slide or window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """key, start, end, n of runs of rows no further apart than `gap`."""
    rows = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
