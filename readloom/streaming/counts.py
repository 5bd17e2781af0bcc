"""Streams of reads: running barcode counts and ordered hand-over."""

from __future__ import annotations

import uuid
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.plans.scratch import scratch_root


def barcode_counts(stream: DataFrame, barcode: str) -> DataFrame:
    """Counts by barcode so far; state is one number a barcode, pre-aggregated in each micro-batch."""
    return stream.groupBy(barcode).agg(F.count(F.lit(1)).alias("count"))


def late_counts(stream: DataFrame, time: str, barcode: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by barcode and window of ``time``; windows close ``late`` after the latest time seen."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), barcode).agg(F.count(F.lit(1)).alias("count"))


def run_to_end(counts: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all input there is; the final table, as the executors wrote it.

    Each micro-batch writes the whole table anew (``complete``) or its own rows (``append``), so nothing is
    gathered on the driver; a batch that is run again overwrites its own folder only.
    """
    spark = counts.sparkSession
    root, done = f"{scratch_root(spark)}/stream-{name}-{uuid.uuid4().hex}", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{number:09d}")
        done.append(number)

    query = counts.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], counts.schema)
    folders = [f"{root}/{n:09d}" for n in (sorted(set(done)) if mode == "append" else [max(done)])]
    return spark.read.schema(counts.schema).parquet(*folders)


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hand_over(records: DataFrame, text: str, order: list[str], out: IO[str]) -> int:
    """Writes the text of each record to an open connection in input order; one partition is held at a time."""
    n = 0
    for row in records.orderBy(*order).select(text).toLocalIterator(prefetchPartitions=False):
        out.write(row[0])
        n += 1
    return n
