"""Registered queries: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import context as C
from ..operators import evaluation as EV
from ..operators import reports as RP
from . import sqlgen as S
from . import standins as SI
from .catalog import register, table

LINES = f"({SI.SCORED_LINES_SQL})"
DOCS = f"({SI.DOC_CHANGES_SQL})"
PAGES = f"({SI.PAGE_CHANGES_SQL})"


@register("class_distribution", rows="A1", sql=(
    "SELECT quality AS label, count(*)::BIGINT AS count, count(*)::DOUBLE / sum(count(*)) OVER () AS share "
    "FROM labels WHERE quality IS NOT NULL GROUP BY quality"))
def class_distribution(spark, sf):
    return RP.class_distribution(table(spark, sf, "labels").withColumnRenamed("quality", "label"))


@register("class_distribution_by_repo", rows="A1", sql=(
    "SELECT repo, label, count(*)::BIGINT AS count, "
    "count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY repo) AS share "
    f"FROM {DOCS} WHERE label IS NOT NULL GROUP BY repo, label"))
def class_distribution_by_repo(spark, sf):
    return RP.class_distribution(SI.doc_changes(spark, sf), "label", ["repo"])


_REPO_F1 = (
    "SELECT repo, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1_score FROM ("
    "SELECT repo, count(*) FILTER (WHERE label = 1 AND p > 0.5) AS tp, "
    "count(*) FILTER (WHERE label = 0 AND p > 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND p <= 0.5) AS fn "
    f"FROM {LINES} WHERE repo IS NOT NULL GROUP BY repo)"
)


def _scored(spark, sf):
    return EV.default_prediction(SI.scored_lines(spark, sf))


@register("repo_f1", rows="A13,T2", sql=_REPO_F1)
def repo_f1(spark, sf):
    return RP.repo_f1(_scored(spark, sf))


_REPO_STATS = (
    "SELECT s.repo, s.n_commits, s.n_unique_files, coalesce(f.f1_score, 0.0) AS f1_score FROM ("
    "SELECT repo, count(repo)::BIGINT AS n_commits, count(DISTINCT filepath)::BIGINT AS n_unique_files "
    f"FROM {LINES} WHERE repo IS NOT NULL GROUP BY repo) s LEFT JOIN ({_REPO_F1}) f ON s.repo = f.repo"
)


@register("repo_stats", rows="A3,J3,A14,S10", sql=_REPO_STATS)
def repo_stats(spark, sf):
    s = _scored(spark, sf)
    return RP.repo_stats(s, RP.repo_f1(s))


@register("top_repos", rows="T3", sql=f"SELECT * FROM ({_REPO_STATS}) ORDER BY n_commits DESC, repo ASC LIMIT 10")
def top_repos(spark, sf):
    s = _scored(spark, sf)
    return RP.top_n(RP.repo_stats(s, RP.repo_f1(s)), "n_commits", 10, "repo")


_EXT_LONG = (
    f"WITH e AS (SELECT repo, {S.file_extension('filepath')} AS file_extension FROM {DOCS} WHERE repo IS NOT NULL), "
    "c AS (SELECT repo, file_extension, count(*) AS n FROM e GROUP BY ALL) "
    "SELECT repo, file_extension, n::DOUBLE / sum(n) OVER (PARTITION BY repo) AS share FROM c"
)


@register("extension_share_long", rows="A4,D5", sql=_EXT_LONG)
def extension_share_long(spark, sf):
    return RP.extension_share_long(SI.doc_changes(spark, sf))


@register("extension_share_wide", rows="A4,T6,S10", sql=(
    "SELECT repo, " + ", ".join(
        f"coalesce(max(share) FILTER (WHERE file_extension = '{x}'), 0.0) AS {x}" for x in ("de", "en", "es", "fr"))
    + f" FROM ({_EXT_LONG}) GROUP BY repo ORDER BY repo LIMIT 10"))
def extension_share_wide(spark, sf):
    """The first 10 repositories of the wide table (T6); the extension
    columns are those these repositories have (here the four languages)."""
    return RP.extension_share_wide(SI.doc_changes(spark, sf), 10)


_PATH_LEN = (f"SELECT repo, avg(length(filepath)) AS avg_filepath_length FROM {PAGES} "
             "WHERE repo IS NOT NULL GROUP BY repo")


@register("path_length_by_repo", rows="A5,D4,S10", sql=_PATH_LEN)
def path_length_by_repo(spark, sf):
    return RP.path_length_by_repo(SI.page_changes(spark, sf))


@register("top_repos_path_length", rows="T4", sql=(
    f"SELECT * FROM ({_PATH_LEN}) ORDER BY avg_filepath_length DESC, repo ASC LIMIT 10"))
def top_repos_path_length(spark, sf):
    return RP.top_n(RP.path_length_by_repo(SI.page_changes(spark, sf)), "avg_filepath_length", 10, "repo")


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("ts", (F.col("event_type") == "error").cast("int").alias("label"))


@register("defect_rate_by_hour", rows="A6,D2", sql=(
    "SELECT hour(ts)::INTEGER AS commit_hour, avg(CAST(event_type = 'error' AS INTEGER)::DOUBLE) AS defect_rate "
    "FROM events WHERE ts IS NOT NULL GROUP BY 1"))
def defect_rate_by_hour(spark, sf):
    e = _events(spark, sf)
    return RP.defect_rate_by(e, C.hour_or_null(C.ensure_timestamp(e, "ts")), "commit_hour")


@register("defect_rate_by_weekday", rows="A7,D3", sql=(
    "SELECT (isodow(ts) - 1)::INTEGER AS commit_day, avg(CAST(event_type = 'error' AS INTEGER)::DOUBLE) AS defect_rate "
    "FROM events WHERE ts IS NOT NULL GROUP BY 1"))
def defect_rate_by_weekday(spark, sf):
    e = _events(spark, sf)
    return RP.defect_rate_by(e, C.weekday_or_null(C.ensure_timestamp(e, "ts")), "commit_day")


def _err_sql(cond):
    return (f"SELECT repo, filepath, substring(content_diff, 1, 200) AS content_diff, "
            f"substring(content_full, 1, 200) AS content_full FROM {DOCS} WHERE {cond} "
            "ORDER BY repo, filepath, commit LIMIT 3")


@register("error_samples_fp", rows="P7,T5,S11", sql=_err_sql("label = 0 AND pred = 1"))
def error_samples_fp(spark, sf):
    return RP.error_samples(SI.doc_changes(spark, sf), "fp")


@register("error_samples_fn", rows="P7,T5,S11", sql=_err_sql("label = 1 AND pred = 0"))
def error_samples_fn(spark, sf):
    return RP.error_samples(SI.doc_changes(spark, sf), "fn")
