from pyspark.sql import functions as F

from changelens.operators import prepare as P
from changelens.operators.features import FEATURE_COLUMNS, feature_table


def test_null_safe_many_to_many_join(spark):
    jit = spark.createDataFrame([("c1", "r", "f", b"d1"), ("c1", "r", "f", b"d2"), (None, "r", "f", b"dn")],
                                "commit string, repo string, filepath string, content binary")
    line = spark.createDataFrame([("c1", "r", "f", b"F1"), ("c1", "r", "f", b"F2"), (None, "r", "f", b"FN")],
                                 "commit string, repo string, filepath string, content binary")
    out = P.join_diff_full(jit, line)
    assert set(out.columns) == {"commit", "repo", "filepath", "content_diff", "content_full"}
    assert out.count() == 4 + 1     # 2 x 2 for c1, NULL matches NULL


def test_label_and_decode(spark):
    df = spark.createDataFrame([([],), ([3, 4],), (None,)], "lines array<int>")
    assert [r[0] for r in df.select(P.label_from_lines("lines")).collect()] == [0, 1, None]
    b = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray(b"x\\ny"),)], "c binary")
    got = [r[0] for r in b.select(P.to_text(b, "c")).collect()]
    assert got == ["ab", "x\ny"]
    # genuine replacement characters and the escape character itself stay
    odd = ["a\ufffdb", "\ufdd0", "\ufdd01\ufffd\ufdd00", "\ufffd"]
    b = spark.createDataFrame([(bytearray(t.encode() + b"\xff\xc3"),) for t in odd], "c binary")
    assert [r[0] for r in b.select(P.decode_text("c")).collect()] == odd


def test_file_change_freq_counts_and_nulls(spark):
    df = spark.createDataFrame([("c1", "r", "a"), ("c2", "r", "a"), ("c3", "r", "b"), ("c4", None, "a")],
                               "commit string, repo string, filepath string")
    got = {r.commit: r.file_change_freq for r in P.file_change_freq(df).collect()}
    assert got == {"c1": 2, "c2": 2, "c3": 1, "c4": 0}


def test_feature_table_shape(spark):
    df = spark.createDataFrame(
        [("c1", "numpy", "src/a.py", "2021-03-01T10:00:00+02:00", "import numpy\n", "x = 1\n")],
        "commit string, repo string, filepath string, datetime string, content_full string, content_diff string")
    ft = feature_table(df)
    assert ft.columns == FEATURE_COLUMNS and len(FEATURE_COLUMNS) == 73
    r = ft.first()
    assert (r.commit_hour, r.commit_day, r.repo_domain, r.file_change_freq) == (8, 0, "data_science", 1)


def test_backfill_adds_missing_columns_as_zero(spark):
    from changelens.operators.features import backfill
    out = backfill(spark.createDataFrame([(3, "x")], "loc_full int, repo_domain string"), ["loc_full", "loc_diff"])
    assert out.columns == ["loc_full", "repo_domain", "loc_diff"]
    assert tuple(out.first()) == (3, "x", 0)


def test_constant_columns_are_left_out_of_the_vector(spark):
    from changelens.operators.models import Preprocessor
    df = spark.createDataFrame([("1", 1.0, 5.0, "a"), ("2", 3.0, 5.0, "b")], "id string, x double, same double, c string")
    pre = Preprocessor.fit(df, "id", ["x", "same"], ["c"])
    assert pre.feature_names() == ["x", "c_a", "c_b"]
    assert [r.features.toArray().tolist() for r in pre.transform(df).orderBy("id").collect()] == [
        [-1.0, 1.0, 0.0], [1.0, 0.0, 1.0]]


def test_places_without_names_get_placeholders(spark):
    from changelens.operators.models import named_places
    df = spark.range(1).withColumn("features", F.array(F.lit(1.0)))
    assert named_places(df) == []
    some = {"ml_attr": {"attrs": {"numeric": [{"idx": 1, "name": "b"}]}, "num_attrs": 3}}
    assert named_places(df.withMetadata("features", some)) == ["feature_0", "b", "feature_2"]
