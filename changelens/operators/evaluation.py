"""Evaluation over score tables ``(group..., label, p)`` (E1-E12, A10, A11,
J4, L3, P11-P15).

Everything runs as grouped aggregates over the score table; the driver only
ever sees bounded results (a 100-point grid, 20 histogram edges).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.sinks import CLASS_DISPLAY, MODEL_DISPLAY
from .ranking import prefix_sums


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ddiv(num, den) -> Column:
    """num/den as double, 0 when den is 0 (the library's zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def _join_groups(a: DataFrame, b: DataFrame, g: list[str]) -> DataFrame:
    """Join on the group keys; with no groups both sides are one-group
    tables joined on a constant key (b has one row)."""
    if g:
        return a.join(b, g, "inner")
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


# --------------------------------------------------------------- score table

#: Rows per score and class; ``other`` counts rows whose label is not 0 or 1.
_COUNTS = ("pos", "zero", "other")


def score_counts(scores: DataFrame, group_cols: list[str] | None = None, label: str = "label",
                 p: str = "p") -> DataFrame:
    """One row per (group, score) with its rows per class.

    Curves, threshold counts and areas all derive from this table, so scores
    are scanned once.  NULL and NaN scores are left out here, and only here.
    A table that already holds counts is passed through."""
    if set(_COUNTS) <= set(scores.columns):
        return scores
    y = F.col(label)

    def rows(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return (scores.where(F.col(p).isNotNull() & ~F.isnan(p))
            .groupBy(*(group_cols or []), F.col(p).cast("double").alias(p))
            .agg(rows(y == 1).alias("pos"), rows(y == 0).alias("zero"),
                 rows(F.coalesce((y != 1) & (y != 0), F.lit(True))).alias("other")))


# ---------------------------------------------------------------- thresholds

def grid_value(i: Column, n_steps: int = 100) -> Column:
    """``linspace(0, 1, n_steps)[i]`` bit for bit: i*(1/(n-1)), last = 1.0."""
    step = 1.0 / (n_steps - 1)
    return F.when(i == n_steps - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))


def grid_index(p: Column, n_steps: int = 100) -> Column:
    """Largest grid index i with grid(i) <= p (-1 below the grid)."""
    last = n_steps - 1
    i0 = F.least(F.greatest(F.floor(p * last), F.lit(-1)), F.lit(last)).cast("int")
    down = F.when((i0 >= 0) & (grid_value(i0, n_steps) > p), i0 - 1).otherwise(i0)
    return F.when((down < last) & (grid_value(down + 1, n_steps) <= p), down + 1).otherwise(down)


def mcc_value(tp, fp, fn, tn) -> Column:
    """Matthews correlation in the covariance form; 0 when undefined."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    t0, t1 = tn + fp, fn + tp          # true class sizes
    p0, p1 = tn + fn, fp + tp          # predicted class sizes
    cov_tp = (tp + tn) * n - (t0 * p0 + t1 * p1)
    cov_pp = n * n - (p0 * p0 + p1 * p1)
    cov_tt = n * n - (t0 * t0 + t1 * t1)
    den = cov_tt * cov_pp
    return F.when(den == 0, F.lit(0.0)).otherwise(cov_tp / F.sqrt(den))


def mcc_curve(scores: DataFrame, group_cols: list[str] | None = None, label: str = "label",
              p: str = "p", n_steps: int = 100) -> DataFrame:
    """E1 curve: confusion counts and MCC at each of ``n_steps`` grid points.

    One pass buckets every row by grid interval (partial aggregation, at
    most ``n_steps + 1`` rows per group leave the map side), then suffix
    sums over the dense grid give the counts at ``p >= t``.
    """
    g = group_cols or []
    if set(_COUNTS) <= set(scores.columns):
        pos, neg = F.col("pos"), F.col("zero") + F.col("other")
    else:
        scores = scores.where(F.col(p).isNotNull() & ~F.isnan(p))
        pos = F.when(F.col(label) == 1, 1).otherwise(0)
        neg = 1 - pos
    hist = (scores.withColumn("__b", grid_index(F.col(p), n_steps)).groupBy(*g, "__b")
            .agg(F.sum(pos).cast("long").alias("__pos"), F.sum(neg).cast("long").alias("__neg")))
    totals = hist.groupBy(*g).agg(F.sum("__pos").alias("__P"), F.sum("__neg").alias("__N"))
    grid = totals.select(*g, "__P", "__N", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("i"))
    dense = grid.join(hist.withColumnRenamed("__b", "i"), [*g, "i"], "left").fillna(0, ["__pos", "__neg"])
    w = Window.partitionBy(*g).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (dense.withColumn("tp", F.sum("__pos").over(w)).withColumn("fp", F.sum("__neg").over(w))
           .withColumn("fn", F.col("__P") - F.col("tp")).withColumn("tn", F.col("__N") - F.col("fp")))
    return out.select(*g, F.col("i").cast("int").alias("i"),
                      grid_value(F.col("i"), n_steps).alias("threshold"),
                      *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
                      mcc_value(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("mcc"))


def best_mcc_threshold(curve: DataFrame, group_cols: list[str] | None = None,
                       default_threshold: float = 0.5) -> DataFrame:
    """First (lowest) grid point with the highest MCC; strict '>' from
    a start of (0.5, -1), so an all -1 curve keeps (0.5, -1)."""
    g = group_cols or []
    best = curve.groupBy(*g).agg(F.max(F.struct(F.col("mcc"), (-F.col("i")).alias("ni"),
                                                F.col("threshold"))).alias("b"))
    improved = F.col("b.mcc") > -1.0
    return best.select(*g, F.when(improved, F.col("b.threshold")).otherwise(F.lit(default_threshold)).alias("threshold"),
                       F.when(improved, F.col("b.mcc")).otherwise(F.lit(-1.0)).alias("mcc"))


def apply_threshold(scores: DataFrame, threshold, p: str = "p", out: str = "pred") -> DataFrame:
    """``pred = int(p >= t)``; ``threshold`` is a number or a column."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scores.withColumn(out, (F.col(p) >= t).cast("int"))


def default_prediction(scores: DataFrame, p: str = "p", out: str = "pred") -> DataFrame:
    """The class with the larger probability; a tie (0.5) is class 0."""
    return scores.withColumn(out, (F.col(p) > 0.5).cast("int"))


# ------------------------------------------------------- confusion / report

def confusion_counts(scored: DataFrame, group_cols: list[str] | None = None,
                     label: str = "label", pred: str = "pred") -> DataFrame:
    """E2 as one row per group: tn, fp, fn, tp (one pass, partial agg)."""
    g = group_cols or []
    y, yh = F.col(label), F.col(pred)

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return scored.groupBy(*g).agg(n((y == 0) & (yh == 0)).alias("tn"), n((y == 0) & (yh == 1)).alias("fp"),
                                  n((y == 1) & (yh == 0)).alias("fn"), n((y == 1) & (yh == 1)).alias("tp"))


def confusion_matrix(scored: DataFrame, group_cols: list[str] | None = None,
                     label: str = "label", pred: str = "pred") -> DataFrame:
    """E2 in long form: all four (label, pred) cells, zeros included."""
    return confusion_cells(confusion_counts(scored, group_cols, label, pred), group_cols)


def confusion_cells(c: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """E2 long form from (tn, fp, fn, tp)."""
    g = group_cols or []
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(k).alias("n"))
                      for a, b, k in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*g, F.explode(cells).alias("x")).select(*g, "x.label", "x.pred", "x.n")


def class_metrics(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """E3 per class from (tn, fp, fn, tp): precision, recall, f1, support."""
    g = group_cols or []
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))

    def row(cls, t, f_pos, f_neg):
        return F.struct(F.lit(cls).alias("class"), _ddiv(t, t + f_pos).alias("precision"),
                        _ddiv(t, t + f_neg).alias("recall"),
                        _ddiv(2 * t, 2 * t + f_pos + f_neg).alias("f1_score"),
                        (t + f_neg).cast("long").alias("support"))

    return counts.select(*g, F.explode(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))).alias("r"),
                         _ddiv(tp + tn, tp + tn + fp + fn).alias("accuracy")).select(*g, "r.*", "accuracy")


def _report_row(name, p, r, f, n):
    return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"),
                    f.alias("f1_score"), n.alias("support"))


def classification_report(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg'."""
    g = group_cols or []
    cm = class_metrics(counts, g)
    per = cm.select(*g, F.col("class").cast("string").alias("row"), "precision", "recall", "f1_score", "support")
    agg = cm.groupBy(*g).agg(
        F.first("accuracy").alias("accuracy"), F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    n = F.col("n")
    summary = agg.select(*g, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1_score"),
                 n.alias("support")),
        _report_row("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), n),
        _report_row("weighted avg", _ddiv(F.col("wp"), n), _ddiv(F.col("wr"), n),
                    _ddiv(F.col("wf"), n), n))).alias("r")).select(*g, "r.*")
    return per.unionByName(summary)


def accuracy(scored: DataFrame, group_cols=None, label="label", pred="pred") -> DataFrame:
    """E8."""
    g = group_cols or []
    return scored.groupBy(*g).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


# --------------------------------------------------------------- ROC / PR

def roc_points(scores: DataFrame, group_cols: list[str] | None = None, label: str = "label",
               p: str = "p", n_buckets: int | None = None) -> DataFrame:
    """One point per distinct score (descending), cumulative tps/fps,
    plus the (0, 0) start point (threshold NULL).  Collinear points are
    kept (same curve, same area).  ``scores`` may be a score-count table."""
    g = group_cols or []
    counted = set(_COUNTS) <= set(scores.columns)
    sc = scores if counted else cut_lineage(score_counts(scores, g, label, p))
    sc = sc.select(*g, p, "pos", (F.col("zero") + F.col("other")).alias("neg"))
    cum = prefix_sums(sc, g, p, ["pos", "neg"], descending=True, n_buckets=n_buckets)
    tot = sc.groupBy(*g).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pts = _join_groups(cum, tot, g)
    start = tot.select(*g, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tps"),
                       F.lit(0).cast("long").alias("fps"), F.lit(0).cast("long").alias("pos"),
                       F.lit(0).cast("long").alias("neg"), "n_pos", "n_neg")
    pts = pts.select(*g, F.col(p).cast("double").alias("threshold"), F.col("pos_cum").alias("tps"),
                     F.col("neg_cum").alias("fps"), "pos", "neg", "n_pos", "n_neg").unionByName(start)
    return pts.select(*g, "threshold", "tps", "fps", "pos", "neg", "n_pos", "n_neg",
                      F.when(F.col("n_neg") == 0, F.lit(None)).otherwise(F.col("fps") / F.col("n_neg")).alias("fpr"),
                      F.when(F.col("n_pos") == 0, F.lit(None)).otherwise(F.col("tps") / F.col("n_pos")).alias("tpr"))


def roc_auc(points: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """E5: trapezoids over the ROC points; ties count one half.  Each
    distinct score adds neg*(2*tps - pos)/2 to the rank statistic."""
    g = group_cols or []
    term = F.col("neg").cast("double") * (2 * F.col("tps") - F.col("pos")).cast("double")
    agg = points.where(F.col("threshold").isNotNull()).groupBy(*g).agg(
        F.sum(term).alias("s"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    den = 2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return agg.select(*g, F.when(den == 0, F.lit(None)).otherwise(F.col("s") / den).alias("auc"))


def pr_points(roc: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """precision/recall at each distinct threshold plus the end point
    (precision 1, recall 0, threshold NULL)."""
    g = group_cols or []
    r = roc.where(F.col("threshold").isNotNull())
    pts = r.select(*g, "threshold", _ddiv(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                   F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.col("tps") / F.col("n_pos")).alias("recall"))
    end = roc.where(F.col("threshold").isNull()).select(
        *g, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def best_f1_threshold(pr: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """F1 = 2PR/(P+R+1e-10); first maximum in ascending threshold order."""
    g = group_cols or []
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-10))
    pts = pr.where(F.col("threshold").isNotNull()).withColumn("f1", f1)
    best = pts.groupBy(*g).agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("nt"))).alias("b"))
    return best.select(*g, (-F.col("b.nt")).alias("threshold"), F.col("b.f1").alias("f1"))


# --------------------------------------------------- distribution summaries

def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (two-sided for accuracy)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def describe(scores: DataFrame, p: str = "p", quantiles=(0.25, 0.5, 0.75),
             n_buckets: int | None = None) -> DataFrame:
    """A10: count, mean, std (sample), min, exact linear quantiles, max.

    Quantiles are exact without gathering the column: value counts get
    distributed prefix sums, and the rows holding ranks floor(h), ceil(h)
    (h = (n-1)q) are picked out with a join against a tiny rank table."""
    x = scores.select(F.col(p).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = x.agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                  F.min("v").alias("min"), F.max("v").alias("max"))
    vc = cut_lineage(x.groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    cum = prefix_sums(vc, [], "v", ["c"], descending=False, n_buckets=n_buckets).withColumn(
        "lo", F.col("c_cum") - F.col("c"))                                   # ranks [lo, c_cum)
    qs = stats.select("count", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    qs = qs.withColumn("h", (F.col("count") - 1).cast("double") * F.col("q")).withColumn(
        "k0", F.floor("h")).withColumn("k1", F.ceil("h")).withColumn("t", F.col("h") - F.col("k0"))

    def value_at(k):
        return (qs.join(cum, (F.col(k) >= F.col("lo")) & (F.col(k) < F.col("c_cum")), "inner")
                  .select("q", F.col("v").alias(k + "_v")))
    picked = qs.join(value_at("k0"), "q").join(value_at("k1"), "q")
    qv = picked.select("q", _lerp(F.col("k0_v"), F.col("k1_v"), F.col("t")).alias("value"))
    piv = qv.groupBy().pivot("q", [float(q) for q in quantiles]).agg(F.first("value"))
    names = {float(q): f"p{int(round(q * 100))}" for q in quantiles}
    piv = piv.select(*[F.col(f"`{c}`").alias(names[float(c)]) for c in piv.columns])
    return _join_groups(stats, piv, []).select("count", "mean", "std", "min", *names.values(), "max")


def histogram_edges(lo: float, hi: float, bins: int = 20) -> list[float]:
    """numpy.histogram's edges (range widened by 0.5 when lo == hi)."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [float(e) for e in np.linspace(lo, hi, bins + 1)]


def histogram(scores: DataFrame, p: str = "p", bins: int = 20) -> DataFrame:
    """Density histogram with numpy's binning rule (right edge of the
    last bin inclusive).  Only count/min/max (one row) reach the driver."""
    x = scores.select(F.col(p).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    st = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    spark = scores.sparkSession
    if st["n"] == 0:
        return spark.createDataFrame([], "bin int, left double, right double, count long, density double")
    edges = histogram_edges(st["lo"], st["hi"], bins)
    first, last = edges[0], edges[-1]
    edge = F.array(*[F.lit(e) for e in edges])
    v = F.col("v")
    idx = ((v - F.lit(first)) * F.lit(bins / (last - first))).cast("int")
    idx = F.when(idx == bins, bins - 1).otherwise(idx)
    idx = F.when(v < F.element_at(edge, idx + 1), idx - 1).otherwise(idx)
    idx = F.when((v >= F.element_at(edge, idx + 2)) & (idx != bins - 1), idx + 1).otherwise(idx)
    counts = x.where((v >= first) & (v <= last)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)],
                                  "bin int, left double, right double")
    total = float(st["n"])
    out = frame.join(counts, "bin", "left").fillna(0, ["count"])
    return out.select("bin", "left", "right", F.col("count").cast("long"),
                      (F.col("count") / (F.col("right") - F.col("left")) / F.lit(total)).alias("density"))


# ---------------------------------------------------- model comparisons

def soft_vote(p_a, p_b, w_a: float = 1.0, w_b: float = 2.0) -> Column:
    """L3: weighted mean of two probabilities (weights 1 : 2)."""
    return (F.lit(w_a) * _c(p_a) + F.lit(w_b) * _c(p_b)) / F.lit(w_a + w_b)


def display_model(c) -> Column:
    """Model name -> display name (others unchanged)."""
    m = F.create_map(*[F.lit(x) for kv in MODEL_DISPLAY.items() for x in kv])
    return F.coalesce(m[_c(c)], _c(c))


def display_class(c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CLASS_DISPLAY.items() for x in kv])
    return m[_c(c)]


def evaluate_scores(scores: DataFrame, group_cols: list[str], fixed_threshold: float | None = None,
                    label: str = "label", p: str = "p", with_auc: bool = True) -> dict[str, DataFrame]:
    """E9/E10/E12 building blocks for a long score table.

    Returns ``thresholds`` (group, threshold, mcc), ``counts`` at that
    threshold, ``auc``.  A fixed threshold overrides the MCC optimum and
    the MCC is then reported as NULL (P13), with no curve built.

    The scores are scanned once, into the (group, score) counts.
    """
    g = group_cols
    table = score_counts(scores, g, label, p)
    if table is not scores:
        table = cut_lineage(table)
    if fixed_threshold is None:
        best = best_mcc_threshold(mcc_curve(table, g, label, p), g)
        at = table.join(best.select(*g, "threshold"), g, "inner")  # one row per group
    else:
        best = table.groupBy(*g).agg(F.lit(float(fixed_threshold)).alias("threshold"),
                                     F.lit(None).cast("double").alias("mcc"))
        at = table.withColumn("threshold", F.lit(float(fixed_threshold)))
    above = F.col(p) >= F.col("threshold")

    def rows(cond, kind):
        return F.sum(F.when(cond, F.col(kind)).otherwise(0)).cast("long")
    counts = at.groupBy(*g).agg(rows(~above, "zero").alias("tn"), rows(above, "zero").alias("fp"),
                                rows(~above, "pos").alias("fn"), rows(above, "pos").alias("tp"))
    auc = roc_auc(roc_points(table, g, label, p), g) if with_auc else None
    return {"table": table, "thresholds": best, "counts": counts, "auc": auc}


def compare_models(scores: DataFrame, group_cols=("model", "split"), fixed_threshold=None,
                   label="label", p="p") -> DataFrame:
    """One row per model x split x class with precision, recall, F1,
    support, AUC and accuracy."""
    g = list(group_cols)
    ev = evaluate_scores(scores, g, fixed_threshold, label, p)
    cm = class_metrics(ev["counts"], g)
    return cm.join(ev["auc"], g, "left").select(
        *g, "class", "precision", "recall", "f1_score", "support", F.col("auc").alias("auc_roc"), "accuracy")


def threshold_metrics(scores: DataFrame, group_cols=("model", "split"), fixed_threshold=None,
                      label="label", p="p", digits: int = 3) -> DataFrame:
    """E10 + P14: per model x split threshold, MCC, class-1 precision /
    recall / F1 and accuracy, rounded half-to-even."""
    g = list(group_cols)
    ev = evaluate_scores(scores, g, fixed_threshold, label, p, with_auc=False)
    cm = class_metrics(ev["counts"], g).where(F.col("class") == 1)
    out = cm.join(ev["thresholds"], g, "inner")
    num = ["threshold", "mcc", "precision", "recall", "f1_score", "accuracy"]
    return out.select(*g, *[F.bround(F.col(c), digits).alias(c) for c in num])


def f1_by_model(compare: DataFrame, splits=("test", "val")) -> DataFrame:
    """Class-1 F1 per model with one column per split (outer alignment)."""
    return (compare.where(F.col("class") == 1).groupBy("model")
            .pivot("split", list(splits)).agg(F.first("f1_score")))


def only_rf_xgb(compare: DataFrame, names=("Random Forest", "XGBoost")) -> DataFrame:
    """The two-model comparison, empty unless both models are present.
    The test is part of the plan, over the few rows of the comparison."""
    both = Window.partitionBy(F.lit(1))
    return (compare.where(F.col("model").isin(*names))
            .withColumn("__n", F.size(F.collect_set("model").over(both)))
            .where(F.col("__n") == len(set(names))).drop("__n"))
