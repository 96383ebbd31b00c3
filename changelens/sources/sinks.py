"""Sinks (S5-S12): report tables, run folders, small files on shared storage."""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Display names of the three models and of the two classes.
MODEL_DISPLAY = {"Randomforest": "Random Forest", "Xgboost": "XGBoost",
                 "Votingclassifier": "Voting Classifier"}
CLASS_DISPLAY = {0: "Sin Defectos", 1: "Con Defectos"}


def join_path(base: str, *names: str) -> str:
    """Join names to a folder given as a path or a URI."""
    return "/".join([base.rstrip("/"), *names])


def run_dir(base: str, ts: _dt.datetime | None = None) -> str:
    """Timestamped output folder ``base/run_YYYYmmdd_HHMMSS``."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc)
    return join_path(base, ts.strftime("run_%Y%m%d_%H%M%S"))


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = True) -> None:
    """Report tables.  ``single_file`` is for tables of a bounded size
    (models x splits, top-k); the rows are brought together after the last
    aggregation, so that still runs in parallel.  Tables with a row per
    repository are written with ``single_file=False``."""
    out = df.repartition(1) if single_file else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text (no line feeds) on the storage that ``path`` names."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=False).first()["value"]


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, on whatever storage it names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []


def _folder(spark: SparkSession, path: str):
    """The storage that ``path`` names, and the path on it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def published_run(spark: SparkSession, base: str, ts: _dt.datetime | None = None):
    """An all-or-nothing run folder.  Gives ``(scratch, final)``: all is
    written below ``scratch``, a hidden folder beside the final one, which takes
    its name by one rename once the block has ended; a manifest of its tables
    and bytes follows in ``base/_manifests``.  An error in the block deletes the
    scratch folder; a killed run leaves it hidden.  An existing run of the same
    second is refused, never mixed with."""
    final = run_dir(base, ts)
    name = final.rsplit("/", 1)[1]
    scratch = join_path(base, f"_{name}.{uuid.uuid4().hex}")
    fs, at = _folder(spark, scratch)
    _, end = _folder(spark, final)
    if fs.exists(end):
        raise FileExistsError(final)
    try:
        fs.mkdirs(at)
        yield scratch, final
        held = {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(at)}
        if fs.exists(end) or not fs.rename(at, end):
            raise FileExistsError(final)
    except BaseException:
        fs.delete(at, True)
        raise
    write_text(spark, join_path(base, "_manifests", name), json.dumps(held, sort_keys=True))


def finished_runs(spark: SparkSession, base: str) -> list[str]:
    """Run folders whose manifest is there and agrees with what they hold, oldest
    first.  Where a rename is no single step (object stores), a run is read
    through this."""
    out = []
    for name in list_folders(spark, join_path(base, "_manifests")):
        fs, at = _folder(spark, join_path(base, name))
        _, done = _folder(spark, join_path(base, "_manifests", name, "_SUCCESS"))
        if not fs.exists(done) or not fs.exists(at):
            continue
        held = {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(at)}
        if held == json.loads(read_text(spark, join_path(base, "_manifests", name))):
            out.append(join_path(base, name))
    return out


def display_name(stem: str) -> str:
    """Folder stem -> model name -> display name."""
    name = stem.replace("_pipeline_model", "").capitalize()
    return MODEL_DISPLAY.get(name, name)
