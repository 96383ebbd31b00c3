import os

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from changelens.operators import neighbours, parallel, smote
from changelens.plans import jobs


def _brute(ids, x, k):
    out = []
    for i, a in zip(ids, x):
        near = sorted((float(((a - b) ** 2).sum()), j) for j, b in zip(ids, x) if j != i)[:k]
        out += [(i, j, p + 1, round(d ** 0.5, 9)) for p, (d, j) in enumerate(near)]
    return sorted(out)


def _got(spark, ids, x, k=5, **params):
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id long, v array<double>")
    return sorted((r.src, r.nb, r.place, round(r.dist, 9)) for r in
                  neighbours.knn_exact(df, "id", "v", k, **params).collect())


@pytest.mark.parametrize("seed,dims,params", [(1, 2, {}), (2, 8, {"slice_rows": 64}), (3, 3, {"pivots": 1}),
                                              (4, 4, {"pivots": 40, "slice_rows": 20})])
def test_against_brute_force(spark, seed, dims, params):
    r = np.random.default_rng(seed)
    x = r.integers(0, 6, (300, dims)).astype(float) if seed == 4 else r.normal(size=(300, dims))  # 4: ties, copies
    x[:100] += 8 * (seed % 2)
    ids = [7 * i for i in range(300)]
    assert _got(spark, ids, x, **params) == _brute(ids, x, 5)


def test_few_rows_and_nulls(spark):
    assert _got(spark, [1, 2], np.array([[0.0], [1.0]])) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]
    df = spark.createDataFrame([(1, [0.0]), (None, [1.0]), (3, None), (4, [5.0])], "id long, v array<double>")
    assert [(r.src, r.nb) for r in neighbours.knn_exact(df, "id", "v").orderBy("src").collect()] == [(1, 4), (4, 1)]
    assert neighbours.knn_exact(df.limit(0), "id", "v").collect() == []


def test_nearest_is_exact_where_a_matrix_product_rounds():
    r = np.random.default_rng(9)
    y = 1e6 + r.integers(0, 4, (700, 16)) * 1e-3  # large values, small and equal distances
    x, ids = y[:300], [f"p{i}" for i in range(700)]
    d = neighbours._squared(x, y)
    got = [np.concatenate(v) for v in zip(*neighbours._nearest(ids[:300], x, ids, y, 5))]
    want = [(i, j, d[i, j]) for i in range(300)
            for j in sorted((j for j in range(700) if j != i), key=lambda j: (d[i, j], ids[j]))[:5]]
    assert list(zip(*(v.tolist() for v in got))) == want
    y[3], y[5, 2] = np.inf, np.nan
    row = np.concatenate([v[0] for v in neighbours._nearest(ids[:300], y[:300], ids, y, 5)])
    assert np.array_equal(np.unique(row), np.setdiff1d(np.arange(300), [3, 5]))


def test_cells_are_bundled():
    """A point is sent to a bundle of small cells once, not to each cell."""
    r = np.random.default_rng(6)
    cells = neighbours._Cells(r.normal(size=(60, 16)))
    cells.size[:] = r.integers(0, 40, 60)
    cells.size[7] = 900
    bundle = neighbours._bundles(cells, 200)
    held = np.bincount(bundle, weights=cells.size)
    assert held[bundle[7]] == 900 and np.delete(held, bundle[7]).max() <= 200
    assert len(held) <= 2 + 2 * cells.size.sum() // 200


def test_recall_on_the_embeddings(spark):
    """The library's defaults, on a class and on all points."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.selectExpr("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    gaps = (x ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(gaps, np.inf)
    want = {int(i): set(ids[np.argsort(g, kind="stable")[:5]].tolist()) for i, g in zip(ids, gaps)}
    found = {}
    for r in neighbours.knn_exact(e, "vec_id", "embedding").collect():
        found.setdefault(r.src, set()).add(r.nb)
    hits = sum(len(want[i] & found[i]) for i in want)
    assert hits >= 0.999 * 5 * len(want)  # ties apart


def test_cells_out_of_reach_are_not_visited():
    r = np.random.default_rng(5)
    centres = r.normal(size=(50, 3)) * 100
    x = np.repeat(centres, 40, axis=0) + r.normal(size=(2000, 3))
    cells = neighbours._Cells(centres)
    home, d = cells.home(x)
    for c in range(50):
        cells.size[c], cells.inner[c], cells.outer[c] = (home == c).sum(), d[home == c].min(), d[home == c].max()
    reach = cells.reach(x, home, np.full(2000, np.inf), 5)
    assert reach[np.arange(2000), home].all() and reach.sum() < 3 * 2000


def test_smote_uses_the_nearest(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8))
    df = spark.createDataFrame([(str(i), v, 1) for i, v in enumerate(x.tolist())], "rep string, x array<double>, weight long")
    got = {}
    for row in smote.neighbours(df, 5).collect():
        got.setdefault(int(row.src), set()).add(int(row.nb))
    gaps = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(gaps, np.inf)
    assert got == {i: set(np.argsort(g)[:5].tolist()) for i, g in enumerate(gaps)}


def test_small_joins_are_dealt_over_the_cores(spark):
    """What is read decides, not a join's estimate."""
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    joined = p.join(e, p["page_id"] == e["event_id"] if "event_id" in e.columns else p["page_id"] == e[e.columns[0]])
    assert "RepartitionByExpression" in parallel.spread(joined)._jdf.queryExecution().optimizedPlan().toString() \
        or "Repartition " in parallel.spread(joined)._jdf.queryExecution().optimizedPlan().toString()


def test_unchosen_texts_are_left_before_the_shuffle(spark):
    line = spark.createDataFrame([("c", "r", f"f{i}", "text") for i in range(5)],
                                 "commit string, repo string, filepath string, content string")
    jit = line.withColumnRenamed("content", "content").selectExpr("*", "array(1) AS lines")
    chosen = jobs.labelled_keys(jit, line).limit(1)
    out = jobs.attach_texts(chosen, jit, line)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
    assert out.count() == 1


def test_memory_errors_of_spark_are_told_from_others():
    class Java(Py4JError):
        pass
    assert jobs.out_of_memory(MemoryError()) and jobs.out_of_memory(OverflowError())
    assert jobs.out_of_memory(PySparkException("Job aborted: java.lang.OutOfMemoryError: Java heap space"))
    assert not jobs.out_of_memory(PySparkException("cannot resolve column")) and not jobs.out_of_memory(ValueError("OutOfMemory"))


def test_forest_importance_finds_what_the_label_is_made_of(spark):
    from changelens.plans.q_ml import forest_importance
    got = {r.feature: r.importance_mean for r in forest_importance(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"p_retailprice", "p_size", "p_brand", "p_type"}
    assert got["p_type"] > 0.2 and abs(got["p_size"]) < 0.1 and abs(got["p_brand"]) < 0.1


def test_no_point_is_shuffled_per_visit(spark):
    """Vectors that no cell keeps apart, so that all slices are visited: the plan of
    the search holds no vector, and what is written is the points once."""
    from changelens.session import ensure_checkpoint_dir
    r = np.random.default_rng(11)
    x = r.normal(size=(1500, 24))
    df = spark.createDataFrame(list(zip(range(1500), x.tolist())), "id long, v array<double>").cache()
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {os.path.join(d, f) for d, _, names in os.walk(top) for f in names}
    out = neighbours.knn_exact(df, "id", "v", 5, slice_rows=100)
    got = sorted((r.src, r.nb, r.place, round(r.dist, 9)) for r in out.collect())
    new = {os.path.join(d, f) for d, _, names in os.walk(top) for f in names} - before
    assert got == _brute(list(range(1500)), x, 5)
    assert sum(map(os.path.getsize, new)) < 1.5 * x.nbytes
    assert "array<double>" not in out._jdf.queryExecution().analyzed().treeString()
    assert "CoGroup" not in out._jdf.queryExecution().analyzed().toString()


def test_what_is_seen_later_only_counts_if_nearer():
    r = np.random.default_rng(12)
    x = r.integers(0, 3, (300, 6)).astype(float)  # many ties
    ids = np.array([f"p{i:03}" for i in range(300)], object)
    d = neighbours._squared(x, x)
    found, mine = neighbours._Found(40, 5), np.arange(40)
    for part in np.split(r.permutation(300), [3, 90, 200]):
        found.add(mine, ids[:40], x[:40], ids[part], x[part])
    want = [(i, ids[j], d[i, j]) for i in range(40)
            for j in sorted((j for j in range(300) if j != i), key=lambda j: (d[i, j], ids[j]))[:5]]
    assert list(zip(found.row.tolist(), found.nb.tolist(), found.sq.tolist())) == want
