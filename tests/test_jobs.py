"""The train -> save -> evaluate flow end to end on the smallest tables."""

import os

import pytest
from conftest import SF_SMALL
from pyspark.errors import PySparkException


def test_size_check_raises(spark):
    from changelens.plans.jobs import check_sizes
    t = spark.createDataFrame([(1,), (0,), (0,), (0,)] * 10, "label int")
    v = spark.createDataFrame([(1,), (0,)] * 10, "label int")
    check_sizes(t, v, 40, 0.25)
    with pytest.raises(ValueError):
        check_sizes(t, v, 60, 0.25)


TRAIN_TABLES = {
    "all_models_comparison", "rf_xgb_comparison", "threshold_metrics", "f1_scores", "classification_reports",
    "confusion_matrices", "roc_points", "vote_pr_curve", "vote_best_f1", "vote_best_f1_report",
    "vote_best_f1_confusion", "confusion_matrix", "prob_summary", "prob_hist", "repo_metrics", "false_positives",
    "false_negatives", "repo_stats", "repo_stats_top10", "extension_stats", "extension_stats_top10",
    "file_naming_stats", "file_naming_stats_top10", "defects_by_hour", "defects_by_day"}
EVALUATION_TABLES = {"all_models_comparison", "rf_xgb_comparison", "threshold_metrics", "f1_scores",
                     "classification_reports", "confusion_matrices", "roc_points"}


def test_train_save_evaluate(spark, tmp_path):
    from changelens.plans import standins as SI
    from changelens.plans.jobs import Config, evaluate, train
    line, jit = SI.doc_splits(spark, SF_SMALL)
    conf = Config(rf_params={"numTrees": 5, "maxDepth": 4},
                  gbt_params={"maxIter": 3, "maxDepth": 3}, max_features=500, svd_k=3, n_train=65,
                  check_sizes=False,   # 13 test rows cannot hit a 0.25 +- 0.01 share (3/13)
                  importance_repeats=1)
    res = train(spark, line, jit, conf, output_dir=f"file://{tmp_path}")
    out = res["reports"]["output_dir"]
    names = set(os.listdir(out.removeprefix("file://")))
    models = {"RandomForest", "XGBoost", "VotingClassifier"}
    assert names == TRAIN_TABLES | {f"{m.lower()}_pipeline_model" for m in models} | {
        f"feature_importance_{t}{m}" for m in models for t in ("", "top20_")}
    shown = set(r.model for r in res["scores"].select("model").distinct().collect())
    assert shown == {"Random Forest", "XGBoost", "Voting Classifier"}
    assert {r[0] for r in res["reports"]["all_models_comparison"].select("class").collect()} == {
        "Sin Defectos", "Con Defectos"}
    imp = res["reports"]["feature_importance_RandomForest"].collect()
    assert {"content_text_full", "content_text_diff"} <= {r.feature for r in imp}
    # the evaluation reads test and val only
    ev = evaluate(spark, out, {s: line[s] for s in ("test", "val")}, {s: jit[s] for s in ("test", "val")}, conf,
                  output_dir=f"file://{tmp_path}/ev")
    assert set(os.listdir(ev["reports"]["output_dir"].removeprefix("file://"))) == EVALUATION_TABLES
    tm = ev["reports"]["threshold_metrics"].collect()
    assert len(tm) == 6 and all(0.0 <= r.threshold <= 1.0 for r in tm)
    # reloaded models score the same rows as the trained ones
    a = {(r.model, r.split, r.commit): r.p for r in res["scores"].collect()}
    b = {(r.model, r.split, r.commit): r.p for r in ev["scores"].collect()}
    common = set(a) & set(b)
    assert common and all(a[k] == pytest.approx(b[k]) for k in common)


def _tables(spark, lines):
    jit = spark.createDataFrame([(f"c{i}", "r", "f.py", b"d" * 50, x, "2021-01-01") for i, x in enumerate(lines)],
                                "commit string, repo string, filepath string, content binary, lines array<int>, "
                                "datetime string")
    line = spark.createDataFrame([(f"c{i}", "r", "f.py", b"f" * 50) for i in range(len(lines))] + [("c0", "r", "f.py", b"g")],
                                 "commit string, repo string, filepath string, content binary")
    return jit, line


def test_null_lines_are_rejected_with_their_number(spark):
    from changelens.plans.jobs import labelled_keys
    jit, line = _tables(spark, [[1], [], None, None])
    with pytest.raises(ValueError, match="2 rows of train"):
        labelled_keys(jit, line, "train")


def test_texts_join_only_the_chosen_rows(spark):
    from changelens.plans.jobs import attach_texts, labelled_keys
    jit, line = _tables(spark, [[1], [], [2]])
    keys = labelled_keys(jit, line)
    assert "content" not in " ".join(keys.columns)       # what is sampled holds no text
    assert keys.count() == 4                             # c0 meets two full texts
    twice = keys.union(keys.where("commit = 'c1'"))
    out = attach_texts(twice, jit, line)
    assert sorted((r.commit, r.label, len(r.content_full)) for r in out.collect()) == [
        ("c0", 1, 1), ("c0", 1, 50), ("c1", 0, 50), ("c1", 0, 50), ("c2", 1, 50)]
    assert {"datetime", "content_diff", "lines"} <= set(out.columns)


def test_a_model_without_memory_ends_the_run(spark, monkeypatch):
    """No scores that lack a configured model."""
    from changelens.plans import jobs
    from changelens.plans import standins as SI
    fit = jobs.MD.fit_calibrated

    def failing(df, kind, *args, **kwargs):
        if kind == "gbt":
            raise PySparkException("Job aborted: java.lang.OutOfMemoryError: Java heap space")
        return fit(df, kind, *args, **kwargs)
    monkeypatch.setattr(jobs.MD, "fit_calibrated", failing)
    line, jit = SI.doc_splits(spark, SF_SMALL)
    conf = jobs.Config(rf_params={"numTrees": 2, "maxDepth": 2}, models=("XGBoost", "RandomForest"), max_features=50,
                       svd_k=2, check_sizes=False, importance=False, smote=False)
    with pytest.raises(PySparkException, match="OutOfMemory"):
        jobs.train(spark, line, jit, conf)
