from pyspark.sql import functions as F

from changelens.operators import sampling as SM


def _data(spark, n0=300, n1=70):
    rows = [(f"k{i}", 0) for i in range(n0)] + [(f"j{i}", 1) for i in range(n1)]
    return spark.createDataFrame(rows, "key string, label int")


def test_exact_sizes_without_replacement(spark):
    df = _data(spark)
    s = SM.sample_exact(df, {0: 120, 1: 40}, ["key"])
    c = SM.class_counts(s)
    assert c == {0: 120, 1: 40}
    assert s.select("key").distinct().count() == 160
    # reproducible
    assert sorted(r.key for r in s.collect()) == sorted(r.key for r in SM.sample_exact(df, {0: 120, 1: 40}, ["key"]).collect())


def test_rank_is_a_permutation_with_small_prefix(spark):
    df = _data(spark)
    r = SM.exact_rank(df, ["key"], ["label"], prefix_len=1)
    for lab, n in ((0, 300), (1, 70)):
        ranks = sorted(x.rank for x in r.where(F.col("label") == lab).collect())
        assert ranks == list(range(n))


def test_bootstrap_and_balance(spark):
    df = _data(spark)
    minority = df.where("label = 1")
    b = SM.sample_bootstrap(minority, 300, ["key"])
    assert b.count() == 300 and b.select("draw").distinct().count() == 300
    bal = SM.balance_classes(df, ["key"])
    assert SM.class_counts(bal) == {0: 70, 1: 70}
    no_rep = SM.balance_classes(df, ["key"], replace=False)
    assert no_rep.where("label = 0").select("key").distinct().count() == 70


def test_folds_and_fraction(spark):
    df = _data(spark)
    f = SM.stratified_folds(df, ["key"], 3)
    sizes = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    for lab in (0, 1):
        v = [sizes[(lab, k)] for k in range(3)]
        assert max(v) - min(v) <= 1
    assert SM.fraction_sample(df, 0.5, ["key"]).count() == 185
    assert SM.target_sizes(193420) == {"test": {0: 29013, 1: 9671}, "val": {0: 19342, 1: 19342}}


def test_null_class_is_refused_or_kept_never_lost(spark):
    import pytest
    rows = [(f"k{i}", 0) for i in range(50)] + [(f"j{i}", 1) for i in range(20)] + [(f"n{i}", None) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, label int")
    assert SM.stratified_folds(df, ["key"], 3).count() == 75
    with pytest.raises(ValueError, match="NULL"):
        SM.balance_classes(df, ["key"])
    kept, n = SM.reject_null_class(df)
    assert n == 5 and SM.class_counts(SM.balance_classes(kept, ["key"])) == {0: 20, 1: 20}


def test_first_ranked_equals_full_ranking(spark):
    df = spark.createDataFrame([(i % 400, i, i % 3) for i in range(900)], "key int, x int, label int")
    ranked = SM.exact_rank(df, ["key"], ["label"], prefix_len=1, out="rk")
    for sizes in ({0: 0, 1: 137, 2: 300}, {0: 1, 1: 999, 2: 299}):
        want = sorted((r.key, r.x) for r in ranked.collect() if r.rk < sizes[r.label])
        got = SM.first_ranked(df, sizes, ["key"], "label", prefix_len=1)
        assert sorted((r.key, r.x) for r in got.collect()) == want


def test_a_sample_shuffles_no_whole_table(spark):
    df = spark.range(2000).selectExpr("id AS key", "repeat('t', 50) AS text")
    plan = SM.first_ranked(df, {None: 700}, ["key"])._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Union"):]
    whole = kept.split("Filter")[1]
    assert "Exchange" not in whole
