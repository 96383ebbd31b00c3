"""Reference-shaped inputs derived by Spark from the driver's tables.

The reference reads commit-diff and full-file tables that the test data
does not contain; these builders map the given tables onto that shape
(see FIXTURES.md §3 and README).  Each has a SQL twin for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import join_diff_full
from .catalog import table

HOST_RE = "^[a-z]+://([^/?#]+)"
PATH_RE = "^[a-z]+://[^/?#]+([^?#]*)"
TAG_RE = "<[^>]*>"


def page_changes(spark: SparkSession, sf: str) -> DataFrame:
    """pages -> one change per page: repo = URL host, filepath = URL path,
    full text = the HTML, diff text = the HTML with tags replaced by blanks,
    commit time = the time of the event with the page's id."""
    times = table(spark, sf, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("datetime"))
    p = table(spark, sf, "pages").join(times, "page_id", "left")
    return p.select(
        F.col("page_id").cast("string").alias("commit"),
        F.regexp_extract("url", HOST_RE, 1).alias("repo"),
        F.regexp_extract("url", PATH_RE, 1).alias("filepath"),
        "datetime",
        F.col("html").alias("content_full"),
        F.regexp_replace("html", TAG_RE, " ").alias("content_diff"),
    )


PAGE_CHANGES_SQL = (
    "SELECT CAST(page_id AS VARCHAR) AS commit, "
    f"regexp_extract(url, '{HOST_RE}', 1) AS repo, "
    f"regexp_extract(url, '{PATH_RE}', 1) AS filepath, "
    "ts AS datetime, html AS content_full, "
    f"regexp_replace(html, '{TAG_RE}', ' ', 'g') AS content_diff FROM pages LEFT JOIN events ON event_id = page_id"
)


def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J1 on text: a user turn (diff side) joined with the assistant reply
    that follows it (full side) on the two keys (conv_id, turn)."""
    c = table(spark, sf, "conversations")
    diff = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("content"))
    full = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    return join_diff_full(diff, full, keys=["conv_id", "turn"], carry=["content"])


CONVERSATION_PAIRS_SQL = (
    "SELECT u.conv_id, u.turn, u.text AS content_diff, a.text AS content_full "
    "FROM conversations u JOIN conversations a "
    "ON u.conv_id IS NOT DISTINCT FROM a.conv_id AND u.turn IS NOT DISTINCT FROM a.turn - 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant'"
)


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a score table: label = returned line, p = 10 x discount
    (11 distinct values, heavy ties), repo = supplier, filepath = part,
    commit = order."""
    li = table(spark, sf, "lineitem")
    p = F.round(F.col("l_discount") * 10, 6)
    return li.select(
        F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("repo"),
        F.col("l_partkey").alias("filepath"), F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("datetime"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), p.alias("p"),
        F.round(F.col("l_tax") * 12.5, 6).alias("p2"), F.col("l_linestatus"),
    )


SCORED_LINES_SQL = (
    "SELECT l_orderkey AS commit, l_suppkey AS repo, l_partkey AS filepath, "
    "l_linenumber AS line, l_shipdate AS datetime, "
    "CAST(l_returnflag = 'R' AS INTEGER) AS label, round(l_discount * 10, 6) AS p, "
    "round(l_tax * 12.5, 6) AS p2, l_linestatus FROM lineitem"
)


def scored_customers(spark: SparkSession, sf: str) -> DataFrame:
    """customer as a continuous score table: p = (acctbal + 1000) / 11000,
    label = market segment BUILDING."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("commit"),
                    (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
                    ((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("p"))


SCORED_CUSTOMERS_SQL = (
    "SELECT c_custkey AS commit, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label, "
    "(c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS p FROM customer"
)


def long_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three 'models' over lineitem in long form (model, split, repo, label, p):
    forest = 10 x discount, boosted = 12.5 x tax, vote = (forest + 2 boosted)/3;
    split = test for open lines, val for the rest."""
    from ..operators.evaluation import display_model, soft_vote
    s = scored_lines(spark, sf).withColumn(
        "split", F.when(F.col("l_linestatus") == "O", F.lit("test")).otherwise(F.lit("val")))
    parts = [("Randomforest", F.col("p")), ("Xgboost", F.col("p2")),
             ("Votingclassifier", soft_vote("p", "p2"))]
    frames = [s.select(display_model(F.lit(m)).alias("model"), "split", "repo", "filepath", "commit",
                       "line", "label", e.alias("p")) for m, e in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


LONG_SCORES_SQL = (
    "SELECT m.model, CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'val' END AS split, repo, filepath, "
    "commit, line, label, CASE m.k WHEN 0 THEN p WHEN 1 THEN p2 "
    "ELSE (1.0::DOUBLE * p + 2.0::DOUBLE * p2) / 3.0::DOUBLE END AS p "
    f"FROM ({SCORED_LINES_SQL}) s, (VALUES (0, 'Random Forest'), (1, 'XGBoost'), (2, 'Voting Classifier')) m(k, model)"
)


def doc_changes(spark: SparkSession, sf: str) -> DataFrame:
    """documents (+ labels): commit = doc id, repo = source, filepath =
    ``<source>/doc<id>.<lang>`` (the language is the file type), label =
    quality (NULL when unlabelled), pred = long document (>= 2000 chars)."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("commit"), F.col("source").alias("repo"),
        F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("filepath"),
        F.col("text").alias("content_full"), F.col("text").alias("content_diff"),
        F.col("quality").alias("label"), (F.col("n_chars") >= 2000).cast("int").alias("pred"))


DOC_CHANGES_SQL = (
    "SELECT d.doc_id AS commit, source AS repo, source || '/doc' || CAST(d.doc_id AS VARCHAR) || '.' || lang AS filepath, "
    "text AS content_full, text AS content_diff, l.quality AS label, CAST(n_chars >= 2000 AS INTEGER) AS pred "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)


def doc_splits(spark: SparkSession, sf: str) -> tuple[dict, dict]:
    """The reference's six inputs built from documents + labels: each
    document is a change (commit = doc id, repo = source, path from
    language); both sides are its whole text as bytes, the commit time is
    that of the event with the document's id, the changed-line list is [1]
    for low-quality documents, [] otherwise; splits are md5 thirds of the
    document ids."""
    from ..operators.sampling import md5_key
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    x = d.join(lab, "doc_id", "left").withColumn(
        "split", F.when(F.conv(F.substring(md5_key(["doc_id"]), 1, 6), 16, 10).cast("long") % 3 == 0, F.lit("test"))
        .when(F.conv(F.substring(md5_key(["doc_id"]), 1, 6), 16, 10).cast("long") % 3 == 1, F.lit("val"))
        .otherwise(F.lit("train")))
    keys = [F.col("doc_id").cast("string").alias("commit"), F.col("source").alias("repo"),
            F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"),
                     F.lit(".py")).alias("filepath")]
    line = x.select(*keys, F.col("text").cast("binary").alias("content"), "split")
    times = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"),
                                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"))
    jit = x.join(times, "doc_id", "left").select(
        *keys, F.col("text").cast("binary").alias("content"),
        F.when(F.col("quality") == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("lines"),
        "datetime", F.array().cast("array<string>").alias("methods"), "split")
    sp = ("train", "test", "val")
    return ({s: line.where(F.col("split") == s).drop("split") for s in sp},
            {s: jit.where(F.col("split") == s).drop("split") for s in sp})
