"""Registered queries: scans, join/label/decode, text metrics, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import context as C
from ..functions.metrics import METRIC_NAMES, token_entropy_by_relation, with_metrics
from ..operators import prepare as P
from ..operators.features import feature_table as build_feature_table
from . import sqlgen as S
from . import standins as SI
from .catalog import register, table

ENTROPY_DIGITS = 9


def _metric_query(name, src_table, id_col, text_col, names, rows):
    rounding = {"token_entropy": ENTROPY_DIGITS}
    sql = S.metrics_query(f"SELECT {id_col}, {text_col} AS c FROM {src_table}", [id_col],
                          names, rounding)

    def build(spark, sf):
        out = table(spark, sf, src_table).select(*[c.strip() for c in id_col.split(",")], text_col)
        out = with_metrics(out, text_col, names=names).drop(text_col)
        if "token_entropy" in names:
            out = out.withColumn("token_entropy", F.round("token_entropy", ENTROPY_DIGITS))
        return out

    register(name, sql, rows)(build)


_metric_query("metrics_all", "documents", "doc_id", "text", METRIC_NAMES, "M1-M34")
_metric_query("metrics_all_pages", "pages", "page_id", "html", METRIC_NAMES, "M1-M34")
_metric_query("metrics_line_counts", "documents", "doc_id", "text",
              ["loc", "num_empty_lines", "length", "avg_line_length", "comment_ratio",
               "empty_ratio", "code_density"], "M1,M13-M18")
_metric_query("metrics_keyword_counts", "pages", "page_id", "html",
              ["num_defs", "num_classes", "num_imports", "num_comments", "comment_ratio",
               "num_operators", "num_docstrings"], "M2-M4,M12,M16,M29,M31")
_metric_query("metrics_flags", "pages", "page_id", "html",
              ["has_try_except", "has_if_else", "uses_torch", "uses_numpy", "uses_cv2",
               "has_return", "has_raise", "has_tab_mix", "has_unclosed_parens"], "M5-M11,M21,M22")
_metric_query("metrics_entropy", "documents", "doc_id", "text", ["token_entropy"], "M19")


@register("metrics_entropy_by_relation", rows="M19", sql=S.metrics_query(
    "SELECT page_id, html AS c FROM pages", ["page_id"], ["token_entropy"], {"token_entropy": ENTROPY_DIGITS}))
def metrics_entropy_by_relation(spark, sf):
    """Token entropy of whole pages from counts per (page, token)."""
    out = token_entropy_by_relation(table(spark, sf, "pages"), ["page_id"], "html")
    return out.withColumn("token_entropy", F.round("token_entropy", ENTROPY_DIGITS))


_metric_query("metrics_indent", "conversations", "conv_id, turn", "text",
              ["num_indent_levels", "avg_indent_length", "max_indent_length"], "M20,M26,M27")
_metric_query("metrics_repetition", "documents", "doc_id", "text",
              ["repetition_score", "avg_words_per_line"], "M23,M30")
_metric_query("metrics_complexity", "documents", "doc_id", "text",
              ["num_decision_points", "num_external_calls", "num_error_keywords"], "M24,M25,M32")
_metric_query("metrics_todo", "pages", "page_id", "html",
              ["num_todo_comments", "todo_ratio"], "M28,M33")


@register("metrics_null_text", rows="M34", sql=S.metrics_query(
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS c FROM documents", ["doc_id"], METRIC_NAMES,
    {"token_entropy": ENTROPY_DIGITS}))
def metrics_null_text(spark, sf):
    """All metrics with every tenth text NULL: such a row is all zero."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text"))
    out = with_metrics(d, "text", names=METRIC_NAMES).drop("text")
    return out.withColumn("token_entropy", F.round("token_entropy", ENTROPY_DIGITS))


@register("scan_changes", rows="S1,S2,P1",
          sql="SELECT doc_id, source, lang, n_chars FROM documents")
def scan_changes(spark, sf):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    from ..sources import read_table
    schema = StructType([StructField("doc_id", LongType()), StructField("source", StringType()),
                         StructField("lang", StringType()), StructField("n_chars", LongType())])
    return read_table(spark, f"{sf.rstrip('/')}/documents.parquet", schema).select(
        "doc_id", "source", "lang", "n_chars")


@register("join_diff_full", rows="J1,P1,P2", sql=(
    "SELECT d.l_orderkey, d.l_partkey, d.l_suppkey, d.l_linenumber, d.l_quantity, "
    "d.l_extendedprice AS l_extendedprice_diff, f.l_extendedprice AS l_extendedprice_full, f.l_tax "
    "FROM lineitem d JOIN lineitem f ON d.l_orderkey IS NOT DISTINCT FROM f.l_orderkey "
    "AND d.l_partkey IS NOT DISTINCT FROM f.l_partkey AND d.l_suppkey IS NOT DISTINCT FROM f.l_suppkey"))
def join_diff_full(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    diff = li.select(*keys, "l_linenumber", "l_quantity", "l_extendedprice")
    full = li.select(*keys, "l_extendedprice", "l_tax")
    return P.join_diff_full(diff, full, keys=keys, carry=["l_extendedprice", "l_tax"])


@register("conversation_pairs", rows="J1,P2", sql=SI.CONVERSATION_PAIRS_SQL)
def conversation_pairs(spark, sf):
    return SI.conversation_pairs(spark, sf)


@register("label_from_lines", rows="P3", sql=(
    "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_lines, "
    "CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 0 ELSE 1 END AS label "
    "FROM lineitem GROUP BY l_orderkey"))
def label_from_lines(spark, sf):
    """An order's returned line numbers play the changed-line list."""
    li = table(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("lines"))
    return lines.select("l_orderkey", F.size("lines").cast("long").alias("n_lines"),
                        P.label_from_lines("lines").alias("label"))


@register("decode_utf8", rows="P4", sql=(
    "SELECT doc_id, text || chr(65533) || text || chr(64976) || '1' AS content FROM documents"))
def decode_utf8(spark, sf):
    """Each text twice, with bad bytes and a genuine U+FFFD between: the bad
    bytes go, the character stays (as does the decoder's escape character)."""
    text = F.col("text").cast("binary")
    raw = F.concat(text, F.unhex(F.lit("FFC3")), F.lit("\ufffd").cast("binary"), text, F.unhex(F.lit("E282")),
                   F.lit("\ufdd01").cast("binary"))
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return d.select("doc_id", P.decode_text("raw").alias("content"))


@register("unescape_newlines", rows="P5", sql=(
    "SELECT page_id, replace(replace(html, '<br>', '\\n'), '\\n', chr(10)) AS content FROM pages"))
def unescape_newlines(spark, sf):
    p = table(spark, sf, "pages")
    escaped = F.replace(F.col("html"), F.lit("<br>"), F.lit("\\n"))
    return p.select("page_id", P.unescape_newlines(escaped).alias("content"))


@register("clean_code", rows="D8", sql=(
    f"SELECT page_id, {S.clean_code('html')} AS content_text FROM pages"))
def clean_code(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.clean_code("html").alias("content_text"))


@register("clean_code_docs", rows="D8", sql=(
    f"SELECT doc_id, {S.clean_code('text')} AS content_text FROM documents"))
def clean_code_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.clean_code("text").alias("content_text"))


@register("repo_domain", rows="D6", sql=(
    f"SELECT page_id, {S.repo_domain('url')} AS repo_domain FROM pages"))
def repo_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.repo_domain("url").alias("repo_domain"))


@register("path_purpose", rows="D7", sql=(
    f"SELECT page_id, {S.path_purpose('url')} AS purpose FROM pages"))
def path_purpose(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.path_purpose("url").alias("purpose"))


@register("file_extension", rows="D5,D4", sql=(
    f"SELECT page_id, {S.file_extension('url')} AS file_extension, "
    "length(url)::BIGINT AS filepath_length FROM pages"))
def file_extension(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", C.file_extension("url").alias("file_extension"),
        C.path_length("url").cast("long").alias("filepath_length"))


@register("commit_time", rows="D1-D3", sql=(
    "SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 0 ELSE hour(ts) END::INTEGER AS commit_hour, "
    "CASE WHEN event_id % 10 = 9 THEN 0 ELSE isodow(ts) - 1 END::INTEGER AS commit_day FROM events"))
def commit_time(spark, sf):
    """Event times written as date texts in four forms (naive ISO, ISO with an
    offset, git, mail) and, every tenth, as no date; parsed back to UTC."""
    e = table(spark, sf, "events")

    def shifted(minutes):
        return F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")
    forms = F.when(F.col("event_id") % 10 == 9, F.lit("not a date")).when(
        F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(
        F.col("event_id") % 4 == 1, F.concat(F.date_format(shifted(120), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(
        F.col("event_id") % 4 == 2, F.concat(F.date_format(shifted(540), "EEE MMM d HH:mm:ss yyyy"), F.lit(" +0900"))
    ).otherwise(F.concat(F.date_format(shifted(-330), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0530")))
    ts = C.parse_commit_time("written")
    return e.select("event_id", forms.alias("written")).select(
        "event_id", C.commit_hour(ts).alias("commit_hour"), C.commit_weekday(ts).alias("commit_day"))


@register("file_change_freq", rows="J2,A2", sql=(
    "SELECT l.l_orderkey, l.l_linenumber, coalesce(c.n, 0)::BIGINT AS file_change_freq "
    "FROM lineitem l LEFT JOIN (SELECT l_suppkey, l_partkey, count(l_orderkey) AS n FROM lineitem "
    "WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2) c "
    "ON l.l_suppkey = c.l_suppkey AND l.l_partkey = c.l_partkey"))
def file_change_freq(spark, sf):
    """Changes per (repo = supplier, file = part), commits = orders."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    out = P.file_change_freq(li, repo="l_suppkey", path="l_partkey", commit="l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "file_change_freq")


def _feature_sql() -> str:
    ms = S.metric_sql()
    names = METRIC_NAMES
    src = SI.PAGE_CHANGES_SQL

    def side(col):
        return (f"SELECT commit, {col} AS c FROM ({src})")

    full = S.metrics_query(side("content_full"), ["commit"], names,
                           {"token_entropy": ENTROPY_DIGITS}, "_full")
    diff = S.metrics_query(side("content_diff"), ["commit"], names,
                           {"token_entropy": ENTROPY_DIGITS}, "_diff")
    del ms
    ctx = (
        "SELECT commit, coalesce(hour(datetime), 0)::INTEGER AS commit_hour, "
        "coalesce(isodow(datetime) - 1, 0)::INTEGER AS commit_day, "
        "length(filepath)::BIGINT AS filepath_length, "
        "(CASE WHEN repo IS NULL OR filepath IS NULL THEN 0 ELSE count(commit) OVER (PARTITION BY repo, filepath) END)::BIGINT AS file_change_freq, "
        f"{S.repo_domain('repo')} AS repo_domain, "
        f"{S.clean_code('content_full')} AS content_text_full, "
        f"{S.clean_code('content_diff')} AS content_text_diff FROM ({src})"
    )
    cols = ", ".join([f"f.{n}_full" for n in names] + [f"d.{n}_diff" for n in names])
    return (f"SELECT x.commit, {cols}, x.commit_hour, x.commit_day, x.filepath_length, "
            "x.file_change_freq, x.repo_domain, x.content_text_full, x.content_text_diff "
            f"FROM ({ctx}) x JOIN ({full}) f ON x.commit = f.commit JOIN ({diff}) d ON x.commit = d.commit")


@register("feature_table", rows="M35,P8-P10,D1-D8,J2,S4", sql=_feature_sql())
def feature_table(spark, sf):
    ft = build_feature_table(SI.page_changes(spark, sf), keep=["commit"])
    for c in ("token_entropy_full", "token_entropy_diff"):
        ft = ft.withColumn(c, F.round(c, ENTROPY_DIGITS))
    return ft
