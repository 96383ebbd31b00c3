"""Session helpers.

Library code never creates its own cluster settings: it reads what the
session has.  ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "changelens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHANGELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is used as is, and it
    must be set.  Only a local master without it (tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="changelens-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # core setting, not modifiable at runtime on some builds
        pass
    sc.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that goes when the session ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def cut_lineage_dealt(df):
    """As ``cut_lineage``, for rows whose last shuffle has a stated number of
    partitions: the result knows how its rows are dealt, so grouping by that
    needs no other shuffle.  An adaptive plan doesn't tell, and has nothing to
    adapt there, so this one job is planned without it."""
    ensure_checkpoint_dir(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(name, before)


def run_at_once(spark: SparkSession, jobs: Sequence[Callable], at_once: int = 2) -> list:
    """Results of ``jobs`` in their order, up to ``at_once`` of them running
    Spark jobs at a time, each thread in a scheduler pool of its own (which
    shares the cores evenly where the session's scheduler is fair).  The first
    error, in the order of the jobs, is raised; jobs not begun by then are
    left out."""
    if at_once <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    context = spark.sparkContext

    def one(place, job):
        context.setLocalProperty("spark.scheduler.pool", f"fits-{place % at_once}")
        return job()
    with ThreadPoolExecutor(min(at_once, len(jobs))) as threads:
        begun = [threads.submit(inheritable_thread_target(spark)(one), i, job) for i, job in enumerate(jobs)]
        try:
            return [b.result() for b in begun]
        except BaseException:
            for b in begun:
                b.cancel()
            raise
