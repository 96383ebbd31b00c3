"""Registered queries: thresholds, confusion, reports, curves, summaries,
model comparisons (E1-E12, A10, A11, J4, L3, P11-P15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from . import standins as SI
from .catalog import register

LINES = f"({SI.SCORED_LINES_SQL})"
CUST = f"({SI.SCORED_CUSTOMERS_SQL})"
LONG = f"({SI.LONG_SCORES_SQL})"
R = 9  # digits for sums whose float order differs between engines


def _mcc_sql(x: str) -> str:
    return (f"(CASE WHEN ({x}_ctt * {x}_cpp) = 0 THEN 0.0 ELSE {x}_ctp / sqrt({x}_ctt * {x}_cpp) END)")


def curve_sql(src: str, g: list[str]) -> str:
    """Brute force: every row compared with every grid point."""
    gs = "".join(f"s.{c}, " for c in g)
    gsel = "".join(f"{c}, " for c in g)
    return (
        f"WITH s AS (SELECT * FROM {src} WHERE p IS NOT NULL AND NOT isnan(p)), "
        "gr AS (SELECT i, CASE WHEN i = 99 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 99) END AS threshold "
        "FROM range(100) t(i)), "
        f"c AS (SELECT {gs}gr.i, gr.threshold, "
        "count(*) FILTER (WHERE s.label = 1 AND s.p >= gr.threshold) AS tp, "
        "count(*) FILTER (WHERE s.label IS DISTINCT FROM 1 AND s.p >= gr.threshold) AS fp, "
        "count(*) FILTER (WHERE s.label = 1 AND s.p < gr.threshold) AS fn, "
        "count(*) FILTER (WHERE s.label IS DISTINCT FROM 1 AND s.p < gr.threshold) AS tn "
        f"FROM gr, s GROUP BY {gs}gr.i, gr.threshold), "
        "d AS (SELECT *, tp::DOUBLE AS a, fp::DOUBLE AS b, fn::DOUBLE AS cc, tn::DOUBLE AS dd FROM c), "
        "e AS (SELECT *, a + b + cc + dd AS n, dd + b AS t0, cc + a AS t1, dd + cc AS p0, b + a AS p1 FROM d), "
        "f AS (SELECT *, (a + dd) * n - (t0 * p0 + t1 * p1) AS m_ctp, n * n - (p0 * p0 + p1 * p1) AS m_cpp, "
        "n * n - (t0 * t0 + t1 * t1) AS m_ctt FROM e) "
        f"SELECT {gsel}i::INTEGER AS i, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, "
        f"tn::BIGINT AS tn, {_mcc_sql('m')} AS mcc FROM f"
    )


def best_sql(src: str, g: list[str]) -> str:
    part = f"PARTITION BY {', '.join(g)} " if g else ""
    gsel = "".join(f"{c}, " for c in g)
    return (
        f"SELECT {gsel}CASE WHEN mcc > -1 THEN threshold ELSE 0.5 END AS threshold, "
        "CASE WHEN mcc > -1 THEN mcc ELSE -1.0 END AS mcc FROM ("
        f"SELECT *, row_number() OVER ({part}ORDER BY mcc DESC, i ASC) AS rk FROM ({curve_sql(src, g)})) "
        "WHERE rk = 1"
    )


def roc_sql(src: str, g: list[str]) -> str:
    part = f"PARTITION BY {', '.join(g)} " if g else ""
    gsel = "".join(f"{c}, " for c in g)
    gjoin = " AND ".join(f"c.{k} = t.{k}" for k in g) or "TRUE"
    return (
        f"WITH d AS (SELECT {gsel}p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, "
        f"sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM {src} WHERE p IS NOT NULL GROUP BY {gsel}p), "
        f"t AS (SELECT {gsel}sum(pos) AS P, sum(neg) AS N FROM d {'GROUP BY ' + ', '.join(g) if g else ''}), "
        f"c AS (SELECT {gsel}p AS threshold, sum(pos) OVER ({part}ORDER BY p DESC) AS tps, "
        f"sum(neg) OVER ({part}ORDER BY p DESC) AS fps, pos, neg FROM d), "
        "u AS (SELECT " + "".join(f"c.{k}, " for k in g) + "threshold, tps, fps, pos, neg, P, N "
        f"FROM c JOIN t ON {gjoin} UNION ALL SELECT {gsel}NULL::DOUBLE, 0, 0, 0, 0, P, N FROM t) "
        f"SELECT {gsel}threshold, tps::BIGINT AS tps, fps::BIGINT AS fps, pos::BIGINT AS pos, neg::BIGINT AS neg, "
        "CASE WHEN N = 0 THEN NULL ELSE fps::DOUBLE / N::DOUBLE END AS fpr, "
        "CASE WHEN P = 0 THEN NULL ELSE tps::DOUBLE / P::DOUBLE END AS tpr FROM u"
    )


def auc_sql(src: str, g: list[str]) -> str:
    gsel = "".join(f"{c}, " for c in g)
    gb = f"GROUP BY {', '.join(g)}" if g else ""
    return (
        f"SELECT {gsel}CASE WHEN 2.0::DOUBLE * max(P)::DOUBLE * max(N)::DOUBLE = 0 THEN NULL ELSE "
        "sum(neg::DOUBLE * (2 * tps - pos)::DOUBLE) / (2.0::DOUBLE * max(P)::DOUBLE * max(N)::DOUBLE) END AS auc "
        f"FROM (SELECT * FROM ({_roc_with_totals(src, g)}) "
        f"WHERE threshold IS NOT NULL) {gb}"
    )


def _roc_with_totals(src, g):
    # the ROC query with P and N kept
    q = roc_sql(src, g)
    head, tail = q.rsplit(" FROM u", 1)
    return head + ", P, N FROM u" + tail


def counts_sql(src: str, g: list[str], thr_sql: str) -> str:
    gsel = "".join(f"s.{c}, " for c in g)
    gjoin = " AND ".join(f"s.{k} = b.{k}" for k in g) or "TRUE"
    return (
        f"SELECT {gsel}count(*) FILTER (WHERE s.label = 0 AND s.p < b.threshold) AS tn, "
        "count(*) FILTER (WHERE s.label = 0 AND s.p >= b.threshold) AS fp, "
        "count(*) FILTER (WHERE s.label = 1 AND s.p < b.threshold) AS fn, "
        "count(*) FILTER (WHERE s.label = 1 AND s.p >= b.threshold) AS tp "
        f"FROM {src} s JOIN ({thr_sql}) b ON {gjoin} GROUP BY {', '.join(['s.' + c for c in g]) or 'ALL'}"
    )


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


def class_rows_sql(counts: str, g: list[str]) -> str:
    gsel = "".join(f"{c}, " for c in g)
    acc = _div("tp + tn", "tp + tn + fp + fn")
    one = (f"SELECT {gsel}1 AS class, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, "
           f"{_div('2 * tp', '2 * tp + fp + fn')} AS f1_score, (tp + fn)::BIGINT AS support, {acc} AS accuracy FROM k")
    zero = (f"SELECT {gsel}0 AS class, {_div('tn', 'tn + fn')} AS precision, {_div('tn', 'tn + fp')} AS recall, "
            f"{_div('2 * tn', '2 * tn + fn + fp')} AS f1_score, (tn + fp)::BIGINT AS support, {acc} AS accuracy FROM k")
    return f"WITH k AS ({counts}) {zero} UNION ALL {one}"


def fixed_sql(src: str, g: list[str], t: float) -> str:
    gsel = ", ".join(g)
    return f"SELECT DISTINCT {gsel}, {t}::DOUBLE AS threshold, NULL::DOUBLE AS mcc FROM {src}"


# ----------------------------------------------------------------- queries

@register("apply_threshold", rows="P12,L7", sql=(
    f"SELECT commit, line, label, CAST(p >= 0.5 AS INTEGER) AS pred FROM {LINES}"))
def apply_threshold(spark, sf):
    s = SI.scored_lines(spark, sf)
    return EV.apply_threshold(s, 0.5).select("commit", "line", "label", "pred")


@register("confusion_matrix", rows="E2", sql=(
    "SELECT l.label, q.pred, count(s.label) AS n FROM (VALUES (0), (1)) l(label), (VALUES (0), (1)) q(pred) "
    f"LEFT JOIN (SELECT label, CAST(p > 0.5 AS INTEGER) AS pred FROM {LINES}) s "
    "ON s.label = l.label AND s.pred = q.pred GROUP BY l.label, q.pred"))
def confusion_matrix(spark, sf):
    s = EV.default_prediction(SI.scored_lines(spark, sf))
    return EV.confusion_matrix(s).select(F.col("label").cast("int"), F.col("pred").cast("int"), "n")


_REPORT_COUNTS = (f"SELECT count(*) FILTER (WHERE label = 0 AND p <= 0.5) AS tn, "
                  f"count(*) FILTER (WHERE label = 0 AND p > 0.5) AS fp, "
                  f"count(*) FILTER (WHERE label = 1 AND p <= 0.5) AS fn, "
                  f"count(*) FILTER (WHERE label = 1 AND p > 0.5) AS tp FROM {LINES}")


@register("classification_report", rows="E3,E8", sql=(
    f"WITH c AS ({class_rows_sql(_REPORT_COUNTS, [])}) "
    "SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1_score, support FROM c UNION ALL "
    "SELECT 'accuracy', NULL::DOUBLE, NULL::DOUBLE, max(accuracy), sum(support)::BIGINT FROM c UNION ALL "
    "SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT FROM c UNION ALL "
    "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1_score * support) / sum(support), sum(support)::BIGINT FROM c"))
def classification_report(spark, sf):
    s = EV.default_prediction(SI.scored_lines(spark, sf))
    return EV.classification_report(EV.confusion_counts(s))


@register("mcc_curve", rows="E1", sql=curve_sql(LINES, []))
def mcc_curve(spark, sf):
    return EV.mcc_curve(SI.scored_lines(spark, sf))


@register("mcc_curve_customer", rows="E1", sql=curve_sql(CUST, []))
def mcc_curve_customer(spark, sf):
    return EV.mcc_curve(SI.scored_customers(spark, sf))


@register("mcc_best_threshold", rows="E1", sql=best_sql(LINES, []))
def mcc_best_threshold(spark, sf):
    return EV.best_mcc_threshold(EV.mcc_curve(SI.scored_lines(spark, sf)))


@register("mcc_best_threshold_customer", rows="E1", sql=best_sql(CUST, []))
def mcc_best_threshold_customer(spark, sf):
    return EV.best_mcc_threshold(EV.mcc_curve(SI.scored_customers(spark, sf)))


@register("roc_curve", rows="E4", sql=roc_sql(LINES, []))
def roc_curve(spark, sf):
    return EV.roc_points(SI.scored_lines(spark, sf)).drop("n_pos", "n_neg")


@register("roc_curve_customer", rows="E4", sql=roc_sql(CUST, []))
def roc_curve_customer(spark, sf):
    return EV.roc_points(SI.scored_customers(spark, sf)).drop("n_pos", "n_neg")


@register("roc_auc", rows="E5", sql=f"SELECT round(auc, 12) AS auc FROM ({auc_sql(LINES, [])})")
def roc_auc(spark, sf):
    pts = EV.roc_points(SI.scored_lines(spark, sf))
    return EV.roc_auc(pts).select(F.round("auc", 12).alias("auc"))


@register("roc_auc_customer", rows="E5", sql=f"SELECT round(auc, 12) AS auc FROM ({auc_sql(CUST, [])})")
def roc_auc_customer(spark, sf):
    pts = EV.roc_points(SI.scored_customers(spark, sf))
    return EV.roc_auc(pts).select(F.round("auc", 12).alias("auc"))


def _pr_sql(src):
    return (f"WITH r AS ({_roc_with_totals(src, [])}) "
            f"SELECT threshold, {_div('tps', 'tps + fps')} AS precision, "
            "CASE WHEN P = 0 THEN 1.0 ELSE tps::DOUBLE / P::DOUBLE END AS recall FROM r WHERE threshold IS NOT NULL "
            "UNION ALL SELECT NULL::DOUBLE, 1.0, 0.0")


@register("pr_curve", rows="E6", sql=_pr_sql(CUST))
def pr_curve(spark, sf):
    return EV.pr_points(EV.roc_points(SI.scored_customers(spark, sf)))


@register("best_f1_threshold", rows="E7", sql=(
    "SELECT threshold, f1 FROM (SELECT threshold, 2 * precision * recall / (precision + recall + 1e-10) AS f1 "
    f"FROM ({_pr_sql(CUST)}) WHERE threshold IS NOT NULL) ORDER BY f1 DESC, threshold ASC LIMIT 1"))
def best_f1_threshold(spark, sf):
    return EV.best_f1_threshold(EV.pr_points(EV.roc_points(SI.scored_customers(spark, sf))))


@register("score_summary", rows="A10", sql=(
    f"WITH x AS (SELECT p AS v FROM {CUST} WHERE p IS NOT NULL AND NOT isnan(p)), "
    "n AS (SELECT count(*) AS n FROM x), "
    "r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM x), "
    "q AS (SELECT q, (n - 1)::DOUBLE * q AS h FROM n, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(q)), "
    "q2 AS (SELECT q, h, floor(h) AS k0, ceil(h) AS k1 FROM q), "
    "qv AS (SELECT q2.q, h - k0 AS t, r0.v AS a, r1.v AS b FROM q2 JOIN r r0 ON r0.k = q2.k0 JOIN r r1 ON r1.k = q2.k1), "
    "l AS (SELECT q, CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0 - t) ELSE a + (b - a) * t END AS val FROM qv) "
    f"SELECT count(*)::BIGINT AS count, round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std, "
    "min(v) AS min, (SELECT val FROM l WHERE q = 0.25) AS p25, (SELECT val FROM l WHERE q = 0.5) AS p50, "
    "(SELECT val FROM l WHERE q = 0.75) AS p75, max(v) AS max FROM x"))
def score_summary(spark, sf):
    d = EV.describe(SI.scored_customers(spark, sf))
    return d.withColumn("mean", F.round("mean", R)).withColumn("std", F.round("std", R))


@register("score_histogram", rows="A11", sql=(
    f"WITH x AS (SELECT p AS v FROM {CUST} WHERE p IS NOT NULL AND NOT isnan(p)), "
    "st AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, "
    "CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(*) AS n FROM x), "
    "e AS (SELECT i, CASE WHEN i = 20 THEN hi ELSE i * ((hi - lo) / 20) + lo END AS edge FROM st, range(21) t(i)), "
    "b AS (SELECT v, least(floor((v - lo) * (20.0::DOUBLE / (hi - lo)))::INTEGER, 19) AS i0 FROM x, st), "
    "b1 AS (SELECT b.v, CASE WHEN b.v < e.edge THEN i0 - 1 ELSE i0 END AS i1 FROM b JOIN e ON e.i = b.i0), "
    "b2 AS (SELECT CASE WHEN b1.v >= e.edge AND i1 <> 19 THEN i1 + 1 ELSE i1 END AS bin FROM b1 JOIN e ON e.i = b1.i1 + 1), "
    "c AS (SELECT bin, count(*) AS c FROM b2 GROUP BY bin) "
    "SELECT l.i::INTEGER AS bin, l.edge AS \"left\", r.edge AS \"right\", coalesce(c.c, 0)::BIGINT AS count, "
    "coalesce(c.c, 0)::DOUBLE / (r.edge - l.edge) / (SELECT n FROM st)::DOUBLE AS density "
    "FROM e l JOIN e r ON r.i = l.i + 1 LEFT JOIN c ON c.bin = l.i"))
def score_histogram(spark, sf):
    return EV.histogram(SI.scored_customers(spark, sf))


_G = ["model", "split"]


def _compare_sql(fixed=None):
    thr = best_sql(LONG, _G) if fixed is None else fixed_sql(LONG, _G, fixed)
    rows = class_rows_sql(counts_sql(LONG, _G, thr), _G)
    return (f"SELECT c.model, c.split, c.class, c.precision, c.recall, c.f1_score, c.support, "
            f"a.auc AS auc_roc, c.accuracy FROM ({rows}) c LEFT JOIN ({auc_sql(LONG, _G)}) a "
            "ON c.model = a.model AND c.split = a.split")


def _threshold_sql(fixed=None):
    thr = best_sql(LONG, _G) if fixed is None else fixed_sql(LONG, _G, fixed)
    rows = class_rows_sql(counts_sql(LONG, _G, thr), _G)
    num = ["threshold", "mcc", "precision", "recall", "f1_score", "accuracy"]
    return (f"SELECT c.model, c.split, " + ", ".join(f"round_even({'t' if n in ('threshold', 'mcc') else 'c'}.{n}, 3) AS {n}" for n in num)
            + f" FROM ({rows}) c JOIN ({thr}) t ON c.model = t.model AND c.split = t.split WHERE c.class = 1")


@register("compare_models", rows="E9,E1-E5,E8,P15", sql=f"SELECT model, split, class, precision, recall, f1_score, support, round(auc_roc, 12) AS auc_roc, accuracy FROM ({_compare_sql()})")
def compare_models(spark, sf):
    out = EV.compare_models(SI.long_scores(spark, sf))
    return out.withColumn("auc_roc", F.round("auc_roc", 12))


@register("threshold_metrics", rows="E10,P14", sql=_threshold_sql())
def threshold_metrics(spark, sf):
    return EV.threshold_metrics(SI.long_scores(spark, sf))


@register("threshold_metrics_fixed", rows="E12,P13", sql=_threshold_sql(0.3))
def threshold_metrics_fixed(spark, sf):
    return EV.threshold_metrics(SI.long_scores(spark, sf), fixed_threshold=0.3)


@register("f1_by_model", rows="J4,S8", sql=(
    f"SELECT model, max(f1_score) FILTER (WHERE split = 'test') AS test, "
    f"max(f1_score) FILTER (WHERE split = 'val') AS val FROM ({_compare_sql()}) WHERE class = 1 GROUP BY model"))
def f1_by_model(spark, sf):
    return EV.f1_by_model(EV.compare_models(SI.long_scores(spark, sf)))


@register("compare_rf_xgb", rows="P11,S12", sql=(
    f"SELECT model, split, class, precision, recall, f1_score, support, round(auc_roc, 12) AS auc_roc, accuracy "
    f"FROM ({_compare_sql()}) WHERE model IN ('Random Forest', 'XGBoost')"))
def compare_rf_xgb(spark, sf):
    out = EV.only_rf_xgb(EV.compare_models(SI.long_scores(spark, sf)))
    return out.withColumn("auc_roc", F.round("auc_roc", 12))


@register("soft_vote", rows="L3", sql=(
    f"SELECT commit, line, (1.0::DOUBLE * p + 2.0::DOUBLE * p2) / 3.0::DOUBLE AS p_vote FROM {LINES}"))
def soft_vote(spark, sf):
    s = SI.scored_lines(spark, sf)
    return s.select("commit", "line", EV.soft_vote("p", "p2").alias("p_vote"))


@register("accuracy_by_model", rows="E8", sql=(
    f"SELECT model, split, avg(CAST(label = CAST(p > 0.5 AS INTEGER) AS DOUBLE)) AS accuracy FROM {LONG} "
    "GROUP BY model, split"))
def accuracy_by_model(spark, sf):
    s = EV.default_prediction(SI.long_scores(spark, sf))
    return EV.accuracy(s, _G)
