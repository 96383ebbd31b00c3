"""The feature row builder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import context as C
from ..functions.metrics import METRIC_NAMES, with_metrics
from ..sources import require_columns
from .prepare import file_change_freq

REQUIRED = ["content_diff", "content_full", "datetime", "filepath", "repo"]
CONTEXT_COLUMNS = ["commit_hour", "commit_day", "filepath_length", "file_change_freq",
                   "repo_domain", "content_text_full", "content_text_diff"]
FEATURE_COLUMNS = ([m + "_full" for m in METRIC_NAMES] + [m + "_diff" for m in METRIC_NAMES]
                   + CONTEXT_COLUMNS)


def feature_table(df: DataFrame, keep: list[str] | None = None,
                  count_on: DataFrame | None = None) -> DataFrame:
    """73 feature columns per change row (plus ``keep`` passthrough columns).

    Text metrics and cleaning run first, row-local, so the one shuffle (the
    change-frequency join) moves numbers and cleaned text, not raw content.
    ``count_on`` counts change frequency on another frame (e.g. before
    resampling); by default it is counted on ``df`` itself.
    """
    require_columns(df, REQUIRED)
    keep = keep or []
    ts = C.ensure_timestamp(df, "datetime")
    own = ["repo", "filepath", "commit"]
    commit = F.col("commit") if "commit" in df.columns else F.lit(None).cast("string").alias("commit")
    base = df.select(*[c for c in keep if c not in own], "repo", "filepath", commit,
                     ts.alias("__ts"), "content_full", "content_diff")
    m = with_metrics(with_metrics(base, "content_full", "_full"), "content_diff", "_diff")
    m = (m.withColumn("commit_hour", C.commit_hour("__ts").cast("int"))
          .withColumn("commit_day", C.commit_weekday("__ts").cast("int"))
          .withColumn("filepath_length", C.path_length("filepath").cast("long"))
          .withColumn("repo_domain", C.repo_domain("repo"))
          .withColumn("content_text_full", C.clean_code("content_full"))
          .withColumn("content_text_diff", C.clean_code("content_diff"))
          .drop("content_full", "content_diff", "__ts"))
    if count_on is None:
        m = file_change_freq(m)
    else:
        counts = file_change_freq(count_on.select("repo", "filepath", "commit")).select(
            "repo", "filepath", "file_change_freq").dropDuplicates(["repo", "filepath"])
        m = m.join(counts, ["repo", "filepath"], "left").fillna({"file_change_freq": 0})
    return backfill(m.select(*keep, *FEATURE_COLUMNS), FEATURE_COLUMNS)


def backfill(df: DataFrame, expected: list[str]) -> DataFrame:
    """Expected-but-missing columns are added as 0."""
    for c in expected:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df

