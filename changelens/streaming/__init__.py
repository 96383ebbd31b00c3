"""The feature operators on a stream of changes.

The reference is batch only.  Every per-row feature (the 66 text metrics,
time, path, domain, cleaned text) is a plain column expression, so the
same builders apply unchanged to a Structured Streaming DataFrame; the
per-file change count (J2), which needs the whole table, is kept as
streaming state: a running count per (repo, filepath) in ``update`` mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import context as C
from ..functions.metrics import with_metrics
from ..operators.features import REQUIRED
from ..sources import require_columns


def stream_features(changes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Row-local features of a (streaming or batch) change table."""
    require_columns(changes, REQUIRED)
    keep = keep or []
    ts = C.ensure_timestamp(changes, "datetime")
    d = changes.select(*keep, "repo", "filepath", ts.alias("__ts"), "content_full", "content_diff")
    d = with_metrics(with_metrics(d, "content_full", "_full", spread_input=False), "content_diff", "_diff",
                     spread_input=False)
    return (d.withColumn("commit_hour", C.commit_hour("__ts").cast("int"))
             .withColumn("commit_day", C.commit_weekday("__ts").cast("int"))
             .withColumn("filepath_length", C.path_length("filepath").cast("long"))
             .withColumn("repo_domain", C.repo_domain("repo"))
             .withColumn("content_text_full", C.clean_code("content_full"))
             .withColumn("content_text_diff", C.clean_code("content_diff"))
             .drop("content_full", "content_diff", "__ts"))


def running_change_counts(changes: DataFrame, commit: str = "commit") -> DataFrame:
    """J2 as streaming state: changes seen so far per (repo, filepath)."""
    return (changes.where(F.col("repo").isNotNull() & F.col("filepath").isNotNull())
            .groupBy("repo", "filepath").agg(F.count(commit).alias("file_change_freq")))
