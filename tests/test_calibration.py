"""Sigmoid calibration from counts."""

import math

import numpy as np
import pytest

from changelens.operators import models as MD


def _loss(a, b, s, y):
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, z = np.where(y == 1, high, low), a * s + b
    return float(np.mean(np.logaddexp(0, z) - t * z))


def _fit(spark, s, y):
    rows = [(float(x), int(c)) for x, c in zip(s, y)]
    return MD.platt(spark.createDataFrame(rows, "s double, label int"))


@pytest.mark.parametrize("case", ["overlapping", "separable", "reversed", "large scores"])
def test_no_other_map_fits_better(spark, case):
    rnd = np.random.default_rng(3)
    y = rnd.integers(0, 2, 200)
    s = {"overlapping": lambda: np.round(rnd.normal(size=200) + y, 2), "separable": lambda: y + rnd.random(200) / 2,
         "reversed": lambda: rnd.random(200) - y, "large scores": lambda: 1e4 * (rnd.normal(size=200) + y)}[case]()
    a, b = _fit(spark, s, y)
    scale = np.abs(s).max()
    best = _loss(a, b, s, y)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, -1e-3), (-1e-3, 1e-3)):
        assert best <= _loss(a + da / scale, b + db, s, y) + 1e-15
    assert (a < 0) == (case == "reversed")


def test_copies_of_rows_do_not_change_what_counts_say(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1), (None, 1), (float("nan"), 0), (0.5, None), (0.5, 7)]
    df = spark.createDataFrame(rows, "s double, label int")
    known = spark.createDataFrame(rows[:4], "s double, label int")
    assert MD.platt(df) == MD.platt(known)


def test_equal_scores_one_class_and_no_rows(spark):
    a, b = _fit(spark, [0.3] * 5, [1, 1, 0, 1, 1])
    assert a == 0.0 and math.isclose(1 / (1 + math.exp(-b)), (4 * 5 / 6 + 1 / 3) / 5, rel_tol=1e-9)
    a, b = _fit(spark, [0.1, 0.2, 0.3], [1, 1, 1])
    assert math.isclose(1 / (1 + math.exp(-(a * 0.2 + b))), 0.8, rel_tol=1e-6)
    assert MD.platt(spark.createDataFrame([], "s double, label int")) == (0.0, 0.0)
