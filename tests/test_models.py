import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from changelens.operators import models as MD
from changelens.operators.smote import smote


def _vec(spark, n=120, seed=0):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        x = rnd.normal(size=3) + (2.0 * y)
        rows.append((str(i), [float(v) for v in x], y))
    df = spark.createDataFrame(rows, "rid string, x array<double>, label int")
    return df.select("rid", array_to_vector("x").alias("features"), "label")


def test_calibrated_forest_and_vote(spark):
    vec = _vec(spark)
    cm = MD.fit_calibrated(vec, "rf", {"numTrees": 10, "maxDepth": 4}, key_cols=["rid"])
    assert len(cm.parts) == 3
    out = cm.predict(vec).select("label", "p", "pred").collect()
    assert all(0.0 <= r.p <= 1.0 for r in out)
    acc = np.mean([r.label == r.pred for r in out])
    assert acc > 0.8
    vote = MD.fit_calibrated(vec, "vote", {"rf": {"numTrees": 5, "maxDepth": 3}, "gbt": {"maxIter": 3, "maxDepth": 2}},
                             key_cols=["rid"])
    assert vote.predict_proba(vec).count() == 120


def test_save_load_gives_equal_scores(spark, tmp_path):
    from changelens.plans.jobs import load_calibrated, save_calibrated
    vec = _vec(spark, 80, 1)
    cm = MD.fit_calibrated(vec, "rf", {"numTrees": 5, "maxDepth": 3}, key_cols=["rid"])
    path = f"file://{tmp_path}/randomforest_pipeline_model"
    save_calibrated(spark, cm, path)
    back = load_calibrated(spark, path)
    a = {r.rid: r.p for r in cm.predict_proba(vec).collect()}
    b = {r.rid: r.p for r in back.predict_proba(vec).collect()}
    assert a == pytest.approx(b)


def test_macro_f1(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, pred int")
    assert MD._macro_f1_by(df, [], "label").first().f1 == pytest.approx((0.5 + 2 / 3) / 2)


def test_vote_takes_its_members_fold_models(spark):
    vec = _vec(spark, 90, 5)
    p = {"rf": {"numTrees": 4, "maxDepth": 3}, "gbt": {"maxIter": 2, "maxDepth": 2}}
    rf, gbt = (MD.fit_calibrated(vec, k, p[k], key_cols=["rid"]) for k in ("rf", "gbt"))
    reused = MD.fit_calibrated(vec, "vote", p, key_cols=["rid"], members=(rf, gbt))
    fitted = MD.fit_calibrated(vec, "vote", p, key_cols=["rid"])
    a, b = ({r.rid: r.p for r in m.predict_proba(vec).collect()} for m in (reused, fitted))
    assert a == pytest.approx(b)
    assert reused.parts[0][0].models[0] is rf.parts[0][0].models[0]


def test_smote_points_lie_on_minority_segments(spark):
    vec = _vec(spark, 80, 2)
    out = smote(vec, "rid", k=3)
    counts = {(r.label, r.synthetic): r["count"] for r in out.groupBy("label", "synthetic").count().collect()}
    assert counts[(1, 0)] + counts.get((1, 1), 0) == counts[(0, 0)]
    mino = np.array([r[0] for r in vec.where("label = 1").select(vector_to_array("features")).collect()])
    syn = np.array([r[0] for r in out.where("synthetic = 1").select(vector_to_array("features")).collect()])
    lo, hi = mino.min(axis=0) - 1e-9, mino.max(axis=0) + 1e-9
    assert ((syn >= lo) & (syn <= hi)).all()      # convex combinations of minority points


def test_smote_refuses_what_it_cannot_balance(spark):
    vec = _vec(spark, 40, 2)
    one = vec.where("label = 0").union(vec.where("label = 1").limit(1))
    with pytest.raises(ValueError, match="one row"):
        smote(one, "rid")
    with pytest.raises(ValueError, match="two classes"):
        smote(vec.withColumn("label", F.expr("CASE WHEN rid = '3' THEN NULL ELSE label END")), "rid")


def test_smote_of_copies(spark):
    """Copies are each other's nearest neighbours and make no more pairs."""
    rows = [(str(i), [1.0, 2.0], 1) for i in range(30)] + [(f"a{i}", [float(i), 0.0], 0) for i in range(80)]
    df = spark.createDataFrame(rows, "rid string, x array<double>, label int").select(
        "rid", array_to_vector("x").alias("features"), "label")
    out = smote(df, "rid").where("synthetic = 1")
    assert out.count() == 50
    assert {tuple(r[0]) for r in out.select(vector_to_array("features")).collect()} == {(1.0, 2.0)}


@pytest.mark.parametrize("copies", [False, True])
def test_pairs_per_point_do_not_grow(spark, copies):
    from changelens.operators.smote import candidate_pairs, distinct_points
    per_point = []
    for n in (400, 4000):
        x = np.random.default_rng(n).normal(size=(n, 4))
        if copies:
            x[n // 2:] = x[0]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select(
            "id", array_to_vector("x").alias("features"))
        points = distinct_points(df, "id")
        per_point.append(candidate_pairs(points).count() / points.count())
    assert max(per_point) <= 64  # directions x window; the rest below it is overlap of the directions


def test_neighbours_are_near(spark):
    from changelens.operators.smote import distinct_points, neighbours
    x = np.random.default_rng(4).normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select(
        "id", array_to_vector("x").alias("features"))
    got = {}
    for r in neighbours(distinct_points(df, "id"), 5, directions=12, window=10).collect():
        got.setdefault(r.src, set()).add(r.nb)
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {i: set(np.argsort(gaps[i])[1:6].tolist()) for i in range(300)}
    assert all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & want[i]) / 5 for i in range(300)]) > 0.7


def test_random_search_scores_what_it_returns(spark):
    vec = _vec(spark, 80, 3)
    base = {"numTrees": 3, "featureSubsetStrategy": "all"}
    seen = []

    def resample(d):
        seen.append(d.count())
        return d
    best, score = MD.random_search(vec, "rf", {"maxDepth": [2, 3]}, n_candidates=2, base=base, key_cols=["rid"],
                                   resample=resample)
    assert best["maxDepth"] in (2, 3) and 0 <= score <= 1
    assert len(seen) == 2 and sum(seen) == 80        # the training part of each fold, once
    grid = MD.SEARCH_GRIDS["VotingClassifier"]
    best, _ = MD.random_search(vec, "vote", grid, n_candidates=3, key_cols=["rid"],
                               base={"rf": {"numTrees": 3, "maxDepth": 2}, "gbt": {"maxIter": 2, "maxDepth": 2}})
    assert best["voting"] in ("hard", "soft") and tuple(best["weights"]) in grid["weights"]


def test_permutation_importance_one_pass(spark):
    rows = [(str(i), float(i % 7), float(i % 3), int(i % 7 >= 4)) for i in range(140)]
    df = spark.createDataFrame(rows, "rid string, a double, b double, label int")

    def score(d):   # predicts from column a only
        return d.withColumn("pred", (F.col("a") >= 4).cast("int"))

    imp = {r.feature: r for r in MD.permutation_importance(df, ["a", "b"], score, "rid", 5).collect()}
    assert imp["b"].importance_mean == 0.0 and imp["b"].importance_std == 0.0
    assert imp["a"].importance_mean > 0.2


def test_svd_components_equal_the_exact_ones(spark):
    from changelens.operators.text_features import svd_components
    r = np.random.default_rng(3)
    x = r.random((400, 150)) * (r.random((400, 150)) < 0.08)    # values that fall slowly
    df = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))],
                               "id long, index int, weight double")
    got = svd_components(df, "id", 150, 20)
    v = np.array([row.loadings for row in got.orderBy("index").collect()])
    exact = np.linalg.svd(x, full_matrices=False)[2][:20]
    assert np.abs((exact * v.T).sum(axis=1)).min() > 0.999
