import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import evaluation as EV


def _mcc(y, yp):
    tp = int(((y == 1) & (yp == 1)).sum()); tn = int(((y == 0) & (yp == 0)).sum())
    fp = int(((y == 0) & (yp == 1)).sum()); fn = int(((y == 1) & (yp == 0)).sum())
    n = tp + tn + fp + fn
    t = np.array([tn + fp, fn + tp]); p = np.array([tn + fn, fp + tp])
    cov_ytyp = (tp + tn) * n - t @ p
    cov_ypyp = n * n - p @ p
    cov_ytyt = n * n - t @ t
    return 0.0 if cov_ypyp * cov_ytyt == 0 else cov_ytyp / np.sqrt(cov_ytyt * cov_ypyp)


def _best_mcc(y, p):
    best, bt = -1.0, 0.5
    for t in np.linspace(0, 1, 100):
        m = _mcc(y, (p >= t).astype(int))
        if m > best:
            best, bt = m, t
    return bt, best


def _auc(y, p):
    order = np.argsort(p, kind="mergesort")
    ranks = np.empty(len(p))
    sp = p[order]
    i = 0
    while i < len(p):
        j = i
        while j + 1 < len(p) and sp[j + 1] == sp[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    P = (y == 1).sum(); N = len(y) - P
    return (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)


def _cases():
    rnd = np.random.default_rng(5)
    cases = []
    for k in range(25):
        n = int(rnd.integers(5, 60))
        y = rnd.integers(0, 2, n)
        if k % 5 == 0:
            p = np.round(rnd.random(n) * 10) / 10            # heavy ties, grid points
        elif k % 5 == 1:
            p = np.linspace(0, 1, 100)[rnd.integers(0, 100, n)]   # exactly on the grid
        else:
            p = rnd.random(n)
        cases.append((y, p))
    cases.append((np.array([1, 1, 0, 0]), np.array([0.9, 0.8, 0.2, 0.1])))   # perfect
    cases.append((np.array([1, 1, 0, 0]), np.array([0.1, 0.2, 0.8, 0.9])))   # inverted
    cases.append((np.array([1, 0, 1, 0]), np.array([0.5, 0.5, 0.5, 0.5])))   # all tied
    cases.append((np.array([1, 1, 1]), np.array([0.2, 0.5, 0.7])))           # one class
    return cases


def _frame(spark, cases):
    rows = [(i, int(yy), float(pp)) for i, (y, p) in enumerate(cases) for yy, pp in zip(y, p)]
    return spark.createDataFrame(rows, "case int, label int, p double")


def test_best_mcc_matches_grid_loop(spark):
    cases = _cases()
    got = {r.case: (r.threshold, r.mcc) for r in
           EV.best_mcc_threshold(EV.mcc_curve(_frame(spark, cases), ["case"]), ["case"]).collect()}
    for i, (y, p) in enumerate(cases):
        t, m = _best_mcc(y, p)
        assert got[i][0] == t, (i, got[i], t)
        assert got[i][1] == pytest.approx(m, abs=1e-12)


def test_auc_matches_rank_statistic(spark):
    cases = [c for c in _cases() if 0 < c[0].sum() < len(c[0])]
    got = {r.case: r.auc for r in EV.roc_auc(EV.roc_points(_frame(spark, cases), ["case"], n_buckets=4), ["case"]).collect()}
    for i, (y, p) in enumerate(cases):
        assert got[i] == pytest.approx(_auc(y, p), abs=1e-12)


def test_prefix_sums_across_many_buckets(spark):
    rnd = random.Random(3)
    rows = [(rnd.random(), rnd.randint(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "p double, label int")
    pts = EV.roc_points(df, n_buckets=64).where("threshold IS NOT NULL").orderBy(F.desc("threshold")).collect()
    ys = [l for _, l in sorted(rows, key=lambda r: -r[0])]
    assert [r.tps for r in pts] == list(np.cumsum(ys))


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, pred int")
    cm = {(r.label, r.pred): r.n for r in EV.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r.row: r for r in EV.classification_report(EV.confusion_counts(df)).collect()}
    assert rep["1"].precision == pytest.approx(0.5) and rep["1"].recall == pytest.approx(0.5)
    assert rep["0"].f1_score == pytest.approx(2 / 3)
    assert rep["accuracy"].f1_score == pytest.approx(0.6) and rep["accuracy"].support == 5
    assert rep["weighted avg"].f1_score == pytest.approx((3 * 2 / 3 + 2 * 0.5) / 5)


def test_best_f1_threshold(spark):
    y = np.array([1, 0, 1, 1, 0, 0, 1]); p = np.array([0.9, 0.8, 0.7, 0.6, 0.55, 0.2, 0.1])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, p double")
    best = EV.best_f1_threshold(EV.pr_points(EV.roc_points(df))).first()
    ths = sorted(set(p))
    f1s = []
    for t in ths:
        pred = p >= t
        tp = (pred & (y == 1)).sum(); prec = tp / pred.sum(); rec = tp / (y == 1).sum()
        f1s.append(2 * prec * rec / (prec + rec + 1e-10))
    assert best.threshold == ths[int(np.argmax(f1s))]


def test_describe_and_histogram(spark):
    rnd = np.random.default_rng(1)
    v = np.concatenate([rnd.random(500), [0.25, 0.25, 0.25]])
    df = spark.createDataFrame([(float(x),) for x in v], "p double")
    d = EV.describe(df, n_buckets=16).first()
    assert d["count"] == len(v)
    assert d["p25"] == pytest.approx(np.percentile(v, 25), abs=1e-12)
    assert d["p50"] == pytest.approx(np.percentile(v, 50), abs=1e-12)
    assert d["p75"] == pytest.approx(np.percentile(v, 75), abs=1e-12)
    assert d["std"] == pytest.approx(np.std(v, ddof=1), rel=1e-9)
    h = EV.histogram(df).orderBy("bin").collect()
    dens, _ = np.histogram(v, bins=20, density=True)
    cnt, _ = np.histogram(v, bins=20)
    assert [r["count"] for r in h] == list(cnt)
    assert [r.density for r in h] == pytest.approx(list(dens), rel=1e-12)


def test_threshold_metrics_fixed_threshold(spark):
    rows = [("m", "test", 1, 0.9), ("m", "test", 0, 0.4), ("m", "test", 1, 0.35), ("m", "test", 0, 0.1)]
    df = spark.createDataFrame(rows, "model string, split string, label int, p double")
    r = EV.threshold_metrics(df, fixed_threshold=0.3).first()
    assert r.threshold == 0.3 and r.mcc is None
    assert r.recall == 1.0 and r.precision == pytest.approx(0.667)
    vote = df.select(EV.soft_vote(F.lit(0.3), F.lit(0.6)).alias("v")).first().v
    assert vote == pytest.approx(0.5)


def test_nan_and_null_scores_are_left_out_everywhere(spark):
    rows = [("m", "t", i % 2, i / 20) for i in range(20)]
    bad = rows + [("m", "t", 1, float("nan")), ("m", "t", 0, None)]
    schema = "model string, split string, label int, p double"
    a, b = (spark.createDataFrame(x, schema) for x in (rows, bad))
    for f in (EV.compare_models, EV.threshold_metrics, lambda d: EV.compare_models(d, fixed_threshold=0.3),
              lambda d: EV.roc_points(d, ["model", "split"]), lambda d: EV.mcc_curve(d, ["model", "split"])):
        assert sorted(map(repr, f(a).collect())) == sorted(map(repr, f(b).collect()))


def test_a_tie_at_one_half_is_class_zero(spark):
    df = spark.createDataFrame([(0.5,), (0.500001,), (0.4,)], "p double")
    assert [r.pred for r in EV.default_prediction(df).collect()] == [0, 1, 0]


def test_the_scores_are_scanned_once(spark):
    df = spark.range(500).selectExpr("'m' AS model", "'t' AS split", "CAST(id % 2 AS INT) AS label", "id / 500D AS p")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    counted = df.mapInPandas(count, df.schema)
    EV.compare_models(counted).collect()
    assert seen.value == 500


def test_two_model_comparison_needs_both(spark):
    one = spark.createDataFrame([("XGBoost", 1), ("Other", 0)], "model string, class int")
    assert EV.only_rf_xgb(one).count() == 0
    both = one.union(spark.createDataFrame([("Random Forest", 1)], "model string, class int"))
    assert {r.model for r in EV.only_rf_xgb(both).collect()} == {"XGBoost", "Random Forest"}
