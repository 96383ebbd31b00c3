import os

import pytest
from pyspark.sql import functions as F

from changelens.sources import MissingInputError, read_changes, require_columns
from changelens.sources.sinks import display_name, run_dir, write_report


def _write(spark, base, kind, split):
    if kind == "line":
        df = spark.createDataFrame([("c", "r", "f", bytearray(b"x"))],
                                   "commit string, repo string, filepath string, content binary")
    else:
        df = spark.createDataFrame([("c", "r", "f", bytearray(b"y"), [1], "2021-01-01T00:00:00", [])],
                                   "commit string, repo string, filepath string, content binary, lines array<int>, "
                                   "datetime string, methods array<string>")
    df.write.mode("overwrite").parquet(os.path.join(base, f"{kind}_{split}.parquet"))


def test_missing_inputs_are_listed_together(spark, tmp_path):
    base = str(tmp_path)
    _write(spark, base, "line", "train")
    with pytest.raises(MissingInputError) as e:
        read_changes(spark, base, "line")
    assert "test" in str(e.value) and "val" in str(e.value)
    for s in ("test", "val"):
        _write(spark, base, "line", s)
    got = read_changes(spark, base, "line")
    assert set(got) == {"train", "test", "val"} and got["train"].count() == 1


def test_required_columns_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError, match="z"):
        require_columns(df, ["x", "z"])
    out = run_dir(str(tmp_path))
    write_report(df, f"{out}/t")
    back = spark.read.option("header", True).csv(f"{out}/t")
    assert back.collect()[0].asDict() == {"x": "1", "y": "a"}
    assert display_name("votingclassifier_pipeline_model") == "Voting Classifier"
    assert display_name("xgboost_pipeline_model") == "XGBoost"


def test_schema_types_are_checked(spark):
    from changelens.sources import LINE_SCHEMA, check_schema
    good = spark.createDataFrame([("c", "r", "f", "x")], "commit string, repo string, filepath string, content string")
    check_schema(good, LINE_SCHEMA)
    bad = spark.createDataFrame([("c", "r", "f", 1)], "commit string, repo string, filepath string, content int")
    with pytest.raises(ValueError, match="content: int"):
        check_schema(bad, LINE_SCHEMA)


def test_small_texts_and_folders_by_uri(spark, tmp_path):
    from changelens.sources.sinks import join_path, list_folders, read_text, write_text
    base = f"file://{tmp_path}/m"
    write_text(spark, join_path(base, "a", "meta"), '{"x": 1}')
    assert read_text(spark, join_path(base, "a", "meta")) == '{"x": 1}'
    assert list_folders(spark, base) == ["a"] and list_folders(spark, base + "/none") == []


def test_no_scratch_folder_off_a_local_master():
    from changelens import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_a_run_appears_whole_or_not_at_all(spark, tmp_path):
    import datetime as dt
    import os
    from changelens.sources.sinks import finished_runs, list_folders, published_run, write_report
    base, df = f"file://{tmp_path}/runs", spark.createDataFrame([(1, "a")], "x int, y string")
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    with pytest.raises(RuntimeError, match="between two tables"):
        with published_run(spark, base, when) as (scratch, final):
            write_report(df, f"{scratch}/one")
            assert not os.path.exists(final.removeprefix("file://"))     # readers see none of it
            raise RuntimeError("between two tables")
    assert list_folders(spark, base) == [] and finished_runs(spark, base) == []
    with published_run(spark, base, when) as (scratch, final):
        write_report(df, f"{scratch}/one")
        write_report(df, f"{scratch}/two", "parquet")
    assert final.endswith("run_20240102_030405") and finished_runs(spark, base) == [final]
    assert list_folders(spark, final) == ["one", "two"]
    with pytest.raises(FileExistsError):                                 # a second run of that second
        with published_run(spark, base, when):
            pass
    # a run that lost a file is not read
    part = next(p for p in (tmp_path / "runs" / "run_20240102_030405" / "two").iterdir() if p.suffix == ".parquet")
    part.write_bytes(b"")
    assert finished_runs(spark, base) == []
