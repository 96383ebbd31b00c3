"""Report tables.

All are grouped aggregates; NULL group keys are dropped first, as the
reference's groupby does.  Every top-k carries a tie-break column so the
result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import context as C


def class_distribution(df: DataFrame, label: str = "label", group_cols=None) -> DataFrame:
    """A1: count and share of each label (within each group)."""
    g = list(group_cols or [])
    counts = df.where(F.col(label).isNotNull()).groupBy(*g, label).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*g).agg(F.sum("count").alias("__total"))
    j = counts.join(totals, g) if g else counts.withColumn("__k", F.lit(1)).join(
        totals.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return j.select(*g, label, F.col("count").cast("long"),
                    (F.col("count") / F.col("__total")).alias("share"))


def repo_f1(scored: DataFrame, repo: str = "repo", label: str = "label", pred: str = "pred") -> DataFrame:
    """F1 of class 1 per repository, 0 when there is no class 1 in
    truth or prediction and when the division is 0/0.  One grouped pass
    of conditional counts (partial aggregation map-side)."""
    y, yh = F.col(label), F.col(pred)
    agg = scored.where(F.col(repo).isNotNull()).groupBy(repo).agg(
        F.sum(((y == 1) & (yh == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (yh == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (yh == 0)).cast("long")).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.select(repo, F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / den).alias("f1_score"))


def repo_stats(changes: DataFrame, f1: DataFrame | None = None, repo: str = "repo",
               path: str = "filepath") -> DataFrame:
    """A3 + J3 + A14: rows and distinct files per repository, with the
    per-repository F1 left-joined (0 when missing)."""
    stats = changes.where(F.col(repo).isNotNull()).groupBy(repo).agg(
        F.count(F.col(repo)).alias("n_commits"), F.countDistinct(path).alias("n_unique_files"))
    if f1 is None:
        return stats.withColumn("f1_score", F.lit(0.0))
    # f1 has one row per repository: AQE broadcasts it when small
    return stats.join(f1, repo, "left").fillna({"f1_score": 0.0})


def top_n(df: DataFrame, by: str, n: int, tie: str, ascending: bool = False) -> DataFrame:
    """Top-n with a deterministic tie-break (a bounded TakeOrdered)."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(o, F.col(tie).asc()).limit(n)


def extension_share_long(changes: DataFrame, repo: str = "repo", path: str = "filepath") -> DataFrame:
    """A4 long: share of each file extension within each repository."""
    ext = changes.where(F.col(repo).isNotNull()).select(repo, C.file_extension(path).alias("file_extension"))
    counts = ext.groupBy(repo, "file_extension").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy(repo).agg(F.sum("n").alias("__t"))
    return counts.join(tot, repo).select(repo, "file_extension", (F.col("n") / F.col("__t")).alias("share"))


#: Extension columns a wide table may have; the long table has no such bound.
MAX_EXTENSIONS = 2000


def extension_share_wide(changes: DataFrame, repos: int = 10, repo: str = "repo", path: str = "filepath") -> DataFrame:
    """A4 wide / T6: the first ``repos`` repositories by name, one column per
    extension they have, missing -> 0.  Only those repositories are pivoted,
    with a given column list; ``extension_share_long`` holds the whole table.
    Over ``MAX_EXTENSIONS`` columns are an error."""
    names = changes.where(F.col(repo).isNotNull()).select(repo).distinct().orderBy(repo).limit(repos)
    lng = extension_share_long(changes.join(F.broadcast(names), repo, "left_semi"), repo, path)
    found = [r[0] for r in lng.select("file_extension").distinct().orderBy("file_extension")
             .limit(MAX_EXTENSIONS + 1).collect()]
    if len(found) > MAX_EXTENSIONS:
        raise ValueError(f"over {MAX_EXTENSIONS} file extensions; use the long table")
    if not found:
        return names
    return lng.groupBy(repo).pivot("file_extension", found).agg(F.first("share")).fillna(0.0)


def path_length_by_repo(changes: DataFrame, repo: str = "repo", path: str = "filepath") -> DataFrame:
    """A5: mean path length per repository."""
    return changes.where(F.col(repo).isNotNull()).groupBy(repo).agg(
        F.avg(F.length(path)).alias("avg_filepath_length"))


def defect_rate_by(changes: DataFrame, key, name: str, label: str = "label") -> DataFrame:
    """Mean label per time key (hour, or weekday with Monday = 0)."""
    k = key.alias(name)
    return changes.where(key.isNotNull()).groupBy(k).agg(F.avg(F.col(label).cast("double")).alias("defect_rate"))


def error_samples(scored: DataFrame, kind: str = "fp", n: int = 3, label: str = "label", pred: str = "pred",
                  order=("repo", "filepath", "commit"), prefix: int = 200) -> DataFrame:
    """First ``n`` false positives (or negatives) in a fixed order,
    texts cut to their first ``prefix`` characters (the report's format)."""
    y, yh = F.col(label), F.col(pred)
    cond = (y == 0) & (yh == 1) if kind == "fp" else (y == 1) & (yh == 0)
    rows = scored.where(cond).orderBy(*order).limit(n)
    return rows.select("repo", "filepath", F.substring("content_diff", 1, prefix).alias("content_diff"),
                       F.substring("content_full", 1, prefix).alias("content_full"))
