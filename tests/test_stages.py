"""The Spark ML stages: fit, save, load, equal scores; odd rows."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array

from changelens.operators import models as MD
from changelens.operators import stages as ST

SCHEMA = "rid string, x double, y double, kind string, body string, label int, extra string"
WORDS = ["red", "green", "blue", "gold", "grey", "pink"]


def _rows(n=120, seed=3):
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = int(i % 4 == 0)
        text = " ".join(rnd.choice(WORDS[3 * label:3 * label + 4] if not label else WORDS[2:], 6))
        out.append((str(i), float(rnd.normal() + 2 * label), None if i % 9 == 0 else float(rnd.normal()),
                    None if i % 11 == 0 else "ab"[i % 2], text, label, "e"))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    stages = [ST.FeatureEstimator(numericCols=["x", "y"], categoricalCols=["kind"], textCols=["text=body"],
                                  maxFeatures=50, k=2, keepCols=["label"]),
              ST.CalibratedClassifier(kind="rf", settings=json.dumps({"numTrees": 5, "maxDepth": 3}), oversample=True)]
    return df, Pipeline(stages=stages), Pipeline(stages=stages).fit(df)


def test_a_fit_is_one_pipeline_that_loads_again(spark, fitted, tmp_path):
    df, _, model = fitted
    assert [type(s).__name__ for s in model.stages] == ["FeatureModel", "CalibratedClassifierModel"]  # and no SMOTE
    model.write().overwrite().save(f"file://{tmp_path}/m")
    model.write().overwrite().save(f"file://{tmp_path}/m")          # again, over the old one
    back = PipelineModel.load(f"file://{tmp_path}/m")
    assert [s.uid for s in back.stages] == [s.uid for s in model.stages]
    a, b = ({r.rid: (r.p, r.pred) for r in m.transform(df).collect()} for m in (model, back))
    assert len(a) == 120 and a.keys() == b.keys()                   # every row once, no synthetic one
    assert all(a[k] == pytest.approx(b[k]) for k in a)
    assert MD.named_places(back.transform(df)) == ["x", "y", "kind_a", "kind_b", "kind_missing", "text_component_1",
                                                   "text_component_2"]


def test_unfitted_pipeline_and_params_survive_a_save(fitted, tmp_path):
    _, pipeline, _ = fitted
    pipeline.write().save(f"file://{tmp_path}/p")
    back = Pipeline.load(f"file://{tmp_path}/p").getStages()
    assert back[0].getOrDefault("textCols") == ["text=body"] and back[0].getOrDefault("k") == 2
    assert back[1].getOrDefault("oversample") is True
    assert json.loads(back[1].getOrDefault("settings")) == {"numTrees": 5, "maxDepth": 3}


def test_stage_equals_the_functions_it_wraps(fitted):
    df, _, model = fitted
    pre = MD.Preprocessor.fit(df, "rid", ["x", "y"], ["kind"], {"text": "body"}, 50, 2)
    a, b = ({r.rid: r.v for r in d.select("rid", vector_to_array("features").alias("v")).collect()}
            for d in (pre.transform(df), model.stages[0].transform(df)))
    assert a.keys() == b.keys() and all(np.abs(a[k]) == pytest.approx(np.abs(b[k]), abs=1e-6) for k in a)


def test_odd_rows_are_scored(spark, fitted):
    _, _, model = fitted
    odd = spark.createDataFrame([("n", None, None, None, None, None, None), ("u", 1.0, 2.0, "unseen", "", 1, ""),
                                 ("l", 1e300, -1.0, "a", "red " * 100_000, 0, "z")], SCHEMA)
    got = {r.rid: r for r in model.transform(odd).collect()}
    assert set(got) == {"n", "u", "l"} and all(0.0 <= r.p <= 1.0 and r.pred in (0, 1) for r in got.values())
    assert "extra" not in model.transform(odd).columns and "label" in model.transform(odd).columns
    assert model.transform(odd.limit(0)).count() == 0


def test_all_columns_are_kept_where_none_is_listed(spark):
    df = spark.createDataFrame(_rows(20), SCHEMA)
    stage = ST.FeatureEstimator(numericCols=["x"]).fit(df)
    assert set(stage.transform(df).columns) == set(df.columns) | {"features"}


def test_saved_vote_keeps_weights_and_rule(spark, tmp_path):
    from test_models import _vec
    vec = _vec(spark, 80, 2)
    vote = MD.fit_calibrated(vec, "vote", {"rf": {"numTrees": 3, "maxDepth": 2}, "gbt": {"maxIter": 2, "maxDepth": 2},
                                           "weights": (3, 1), "voting": "hard"}, key_cols=["rid"], at_once=3)
    ST.as_pipeline(vote).write().save(f"file://{tmp_path}/v")
    back = ST.from_pipeline(PipelineModel.load(f"file://{tmp_path}/v"))
    assert back.preprocessor is None and back.parts[0][0].weights == (3, 1) and back.parts[0][0].hard
    a, b = ({r.rid: r.p for r in m.predict_proba(vec).collect()} for m in (vote, back))
    assert a == pytest.approx(b)
