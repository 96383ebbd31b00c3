"""The SVD on a row per document: its products, a term twice, the projection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import text_features as TF


@pytest.fixture(scope="module")
def weights(spark):
    r = np.random.default_rng(5)
    x = r.random((300, 60)) * (r.random((300, 60)) < 0.1)
    x[0] = np.where(np.arange(60) < 2, 0.7, 0.0)
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    rows[:1] = [(0, 0, 0.3), (0, 0, 0.4)]                      # a term twice
    return x, spark.createDataFrame(rows, "id long, index int, weight double")


def test_a_row_per_document_names_repeated_terms(weights):
    x, df = weights
    rows = {r.id: r for r in TF.document_rows(df, "id").collect()}
    assert set(rows) == set(np.flatnonzero(x.any(axis=1)).tolist())
    assert rows[0].twice and sorted(rows[0].i) == [0, 0, 1] and not any(r.twice for i, r in rows.items() if i)
    for i, r in rows.items():
        assert np.bincount(r.i, r.w, 60) == pytest.approx(x[i], abs=1e-12)


def test_normal_product_is_exact(spark, weights):
    x, df = weights
    z = np.random.default_rng(6).standard_normal((60, 7))
    got = TF._normal_product(spark, TF.document_rows(df, "id").select("i", "w", "twice"), z)
    assert np.abs(got - x.T @ (x @ z)).max() < 1e-10


def test_components_and_projection_of_document_rows(weights):
    x, df = weights
    rows = TF.document_rows(df, "id").localCheckpoint()
    assert TF.document_rows(rows, "id") is rows
    one = {r["index"]: r.loadings for r in TF.svd_components(df, "id", 60, 5).collect()}
    comps = TF.svd_components(rows, "id", 60, 5)
    two = {r["index"]: r.loadings for r in comps.collect()}
    assert all(one[j] == pytest.approx(two[j], abs=1e-9) for j in range(60))
    v = np.array([two[j] for j in range(60)])
    for source in (df, rows.repartition(3, F.col("id"))):
        got = {r.id: r.c for r in TF.svd_project(source, comps, "id", 5, "c").collect()}
        assert set(got) == set(np.flatnonzero(x.any(axis=1)).tolist())
        assert all(got[i] == pytest.approx(x[i] @ v, abs=1e-9) for i in got)
