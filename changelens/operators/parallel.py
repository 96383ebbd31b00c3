"""Parallelism guard for CPU-heavy row work, and memory of Python workers."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Deal the rows round-robin over the cluster's cores when the input is
    too small to give each core a scan split (e.g. one Parquet row group).

    Decided from the estimated sizes of what the plan reads; nothing runs.  An input that fills
    the cores by itself stays as it is, so at most ``cores`` splits' worth of
    data is ever shuffled here."""
    spark = df.sparkSession
    target = max(1, spark.sparkContext.defaultParallelism * factor)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # a join's own estimate is a product
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(target) if size < target * split else df


def released(run):
    """``run`` for ``mapInArrow``; when a task ends, the memory it has freed goes
    back to the system, so that a worker does not hold the most it ever needed."""
    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc: nothing to hand back by hand
            pass
    return tidied
