import os

from pyspark.sql import functions as F

from changelens.functions.metrics import with_metrics
from changelens.streaming import running_change_counts, stream_features


def test_stream_features_match_batch(spark, tmp_path):
    rows = [("c1", "numpy", "a/x.py", "2021-03-01T10:00:00+02:00", "import numpy\n# TODO\n", "x = 1\n"),
            ("c2", "numpy", "a/x.py", "2021-03-02T10:00:00", "def f():\n    return 1\n", "y\n"),
            ("c3", "zzz", "b.md", None, "", "")]
    schema = "commit string, repo string, filepath string, datetime string, content_full string, content_diff string"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = stream_features(stream, keep=["commit"]).writeStream.format("memory").queryName("feat_out").start()
    q.processAllAvailable()
    q.stop()
    got = {r.commit: r for r in spark.sql("SELECT * FROM feat_out").collect()}
    batch = {r.commit: r for r in stream_features(spark.createDataFrame(rows, schema), keep=["commit"]).collect()}
    assert got.keys() == batch.keys()
    for k in got:
        assert got[k].asDict() == batch[k].asDict()
    assert got["c1"].commit_hour == 8 and got["c1"].num_todo_comments_full == 1

    counts = running_change_counts(stream).writeStream.outputMode("complete").format("memory") \
        .queryName("freq_out").start()
    counts.processAllAvailable()
    counts.stop()
    freq = {(r.repo, r.filepath): r.file_change_freq for r in spark.sql("SELECT * FROM freq_out").collect()}
    assert freq == {("numpy", "a/x.py"): 2, ("zzz", "b.md"): 1}
