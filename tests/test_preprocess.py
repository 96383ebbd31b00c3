import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import preprocess as PP


def test_null_and_constant_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan"), "a"), (1, None, 2.0, "a"), (1, None, 3.0, "a")],
                               "a int, b int, c double, d string")
    nulls = {r.column: r.n_null for r in PP.null_counts(df).collect()}
    assert nulls == {"a": 0, "b": 3, "c": 1, "d": 0}
    const = {r.column: r.is_constant for r in PP.constant_columns(df).collect()}
    assert const == {"a": True, "b": False, "c": False, "d": True}


def test_scaler_population_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (5.0, 5.0)], "x double, z double")
    prep = PP.NumericPrep.fit(df, ["x", "z"])
    assert prep.kept == ["x"]
    out = df.select(*[prep.scale(c).alias(c) for c in ("x", "z")]).collect()
    x = np.array([1.0, 2.0, 5.0])
    exp = (np.array([1.0, 2.0, x.mean(), 5.0]) - x.mean()) / x.std()
    assert [r.x for r in out] == pytest.approx(list(exp))
    assert all(r.z == 0.0 for r in out)


def test_anova_f(spark):
    rnd = np.random.default_rng(2)
    X = rnd.random((60, 3)); y = rnd.integers(0, 3, 60); X[:, 1] += y
    rows = [(int(y[i]), j, float(X[i, j])) for i in range(60) for j in range(3)]
    long = spark.createDataFrame(rows, "label int, feature int, value double")
    got = {r.feature: r.f_score for r in PP.anova_f(long).collect()}
    for j in range(3):
        groups = [X[y == k, j] for k in range(3)]
        grand = X[:, j].mean()
        ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[j] == pytest.approx((ssb / 2) / (ssw / 57), rel=1e-9)


def test_one_hot_unknown_is_zero(spark):
    cats = PP.one_hot_fit(spark.createDataFrame([("b",), ("a",), (None,)], "c string"), "c")
    test = spark.createDataFrame([("a",), ("zzz",), (None,)], "c string")
    arrs = [r[0] for r in test.select(PP.one_hot_vector("c", cats)).collect()]
    assert arrs == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    assert PP.one_hot_fit(spark.createDataFrame([("b",), (None,)], "c string"), "c") == ["b", "missing"]


def test_one_hot_refuses_an_open_column(spark, monkeypatch):
    monkeypatch.setattr(PP, "MAX_CATEGORIES", 5)
    with pytest.raises(ValueError, match="categories"):
        PP.one_hot_fit(spark.range(9).selectExpr("CAST(id AS STRING) AS c"), "c")


def test_anova_with_one_class_and_with_an_empty_class(spark):
    one = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "label int, feature int, value double")
    assert [r.f_score for r in PP.anova_f(one).collect()] == [None]
    rows = [(0, 0, 1.0), (0, 0, 2.0), (1, 0, 4.0), (1, 0, 6.0)]
    some = spark.createDataFrame(rows + [(2, 0, None)], "label int, feature int, value double")
    full = spark.createDataFrame(rows, "label int, feature int, value double")
    assert PP.anova_f(some).first().f_score == pytest.approx(PP.anova_f(full).first().f_score)
