"""Forest of balanced bootstraps, and fits that run at the same time."""

import hashlib
import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import forest as FO
from changelens.operators import models as MD
from changelens.session import run_at_once
from test_models import _vec


def test_poisson_steps():
    steps = FO.poisson_steps(0.9)
    assert steps[0] == pytest.approx(math.exp(-0.9)) and steps[2] == pytest.approx(
        math.exp(-0.9) * (1 + 0.9 + 0.405))
    assert all(a < b < 1.0 for a, b in zip(steps, steps[1:])) and 1.0 - steps[-1] < 1e-14


def test_draws_and_weights_equal_a_loop(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int")
    steps, want = FO.poisson_steps(0.9), {}
    for t in range(4):
        for i, y in rows:
            u = int(hashlib.md5(f"42|boot|{t}|{i}".encode()).hexdigest()[:13], 16) / 2.0 ** 52
            n = sum(u >= s for s in steps)
            if n:
                d = want.setdefault((t, y), [0, 0])
                d[0] += 1
                d[1] += n
    got = {(r.tree, r.label): r for r in FO.subsample_weights(df, ["id"], 4).collect()}
    assert {k: [r.rows, r.draws] for k, r in got.items()} == want
    for t in range(4):
        assert got[t, 0].weight * got[t, 0].draws == pytest.approx(got[t, 1].weight * got[t, 1].draws)
    mean = df.select(FO.draws(["id"], 7, 0.9).alias("n")).agg(F.avg("n")).first()[0]
    assert 0.7 < mean < 1.1


def test_forest_of_bootstraps_scores_saves_and_loads(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel
    vec = _vec(spark, 200, 4).checkpoint()
    p = {"numTrees": 6, "maxDepth": 4, "subsamplingRate": 0.9}
    model, again = FO.fit_balanced_forest(vec, p), FO.fit_balanced_forest(vec, p, at_once=1)
    assert model.getNumTrees == 6 and len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > 1
    rows = [(r.rid, r.label, r.prediction, r.probability[1]) for r in model.transform(vec).collect()]
    assert np.mean([y == y2 for _, y, y2, _ in rows]) > 0.85
    assert {r[0]: r[3] for r in rows} == pytest.approx({r.rid: r.probability[1] for r in again.transform(vec).collect()})
    # the forest's probability is the mean of its trees' own
    trees = [t.transform(vec.select("features", "rid").orderBy("rid")).select(F.col("probability")).collect()
             for t in model.trees]
    mean = np.mean([[r.probability[1] for r in t] for t in trees], axis=0)
    assert [r[3] for r in sorted(rows)] == pytest.approx(list(mean))
    model.write().save(f"file://{tmp_path}/f")
    back = RandomForestClassificationModel.load(f"file://{tmp_path}/f")
    assert {r.rid: r.probability[1] for r in back.transform(vec).collect()} == pytest.approx({r[0]: r[3] for r in rows})


def test_setting_chooses_the_weights(spark):
    vec = _vec(spark, 90, 6).checkpoint()
    p = {"numTrees": 3, "maxDepth": 2, "classWeight": "balanced_subsample"}
    cm = MD.fit_calibrated(vec, "vote", {"rf": p, "gbt": {"maxIter": 2, "maxDepth": 2}}, key_cols=["rid"])
    assert all(0.0 <= r.p <= 1.0 for r in cm.predict_proba(vec).collect())
    assert cm.parts[0][0].models[0].getNumTrees == 3
    with pytest.raises(ValueError, match="classWeight"):
        MD.fit_scorer(vec, "rf", {"classWeight": "none"}, 1)


def test_odd_bootstraps(spark):
    one = _vec(spark, 40, 8).where("label = 0").checkpoint()          # no row of class 1 at all
    model = FO.fit_balanced_forest(one, {"numTrees": 2, "maxDepth": 2})
    assert model.numClasses == 2 and all(r.probability[1] == 0.0 for r in model.transform(one).collect())
    with pytest.raises(ValueError, match="no rows"):
        FO.fit_balanced_forest(one.limit(0), {"numTrees": 2})


def test_jobs_overlap_keep_order_and_raise(spark):
    meet = threading.Barrier(2, timeout=60)

    def job(i):
        meet.wait()                                                   # passes only if two run at a time
        pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        return i, spark.range(i).count(), pool
    got = run_at_once(spark, [lambda i=i: job(i) for i in range(4)], 2)
    assert [g[:2] for g in got] == [(i, i) for i in range(4)] and {g[2] for g in got} == {"fits-0", "fits-1"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    ran = []

    def fails(i):
        ran.append(i)
        time.sleep(0.2)
        if i == 0:
            raise MemoryError("first")
    with pytest.raises(MemoryError, match="first"):
        run_at_once(spark, [lambda i=i: fails(i) for i in range(50)], 2)
    assert len(ran) < 50


def test_search_has_the_same_winner_at_the_same_time(spark):
    vec = _vec(spark, 80, 3).checkpoint()
    grid, base = {"maxDepth": [1, 2, 3]}, {"numTrees": 3}
    one, more = (MD.random_search(vec, "rf", grid, n_candidates=3, base=base, key_cols=["rid"], at_once=n)
                 for n in (1, 3))
    assert one == more
