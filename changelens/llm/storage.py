"""Shared scratch tables and binary files on the cluster's shared storage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that goes when the session
    ends.  The folder itself is made by whatever writes there first."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}-{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later readers scan only
    the columns they need."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Executor-side access to a shared folder named by URI or plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") \
        else (pafs.LocalFileSystem(), uri)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; when a task ends, the memory it has freed goes
    back to the system, so that workers that serve several operators in turn
    do not hold the most that each of them needed."""
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc: nothing to hand back by hand
            pass
    return tidied


def text_column(batch: pa.RecordBatch, name: str) -> pa.StringArray:
    """A text column of an Arrow batch with nulls as empty strings."""
    return batch.column(name).cast(pa.large_string()).fill_null("")
