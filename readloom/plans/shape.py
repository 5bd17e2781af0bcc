"""Small means of shaping a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores, for the costly Python stage behind it.

    Files of one row group cannot be split, so a small table in one file would keep one core busy.  Tables
    with enough files, as any large one has, pass through without a shuffle.  Only meant for scans: asking
    an adaptive plan with exchanges for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used.

    Projections are merged, and with them expressions are copied into every place that names them; a generator
    of one row stands between, which the optimiser does not look through.
    """
    once = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return once.select(*df.columns, *(F.col(f"_once.{n}").alias(n) for n in columns))


def few(df: DataFrame, limit: int) -> list:
    """All rows, for the driver; more than ``limit`` are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows
