import datetime as dt

from pyspark.sql import functions as F

from changelens.functions import context as C


def test_repo_domain_order(spark):
    repos = ["numpy", "my-array", "home-assistant/core", "zzz", None, "Django", "pandas-core"]
    df = spark.createDataFrame([(r,) for r in repos], "r string")
    got = [x[0] for x in df.select(C.repo_domain("r")).collect()]
    # 'ray' sits inside 'array'; 'core' wins over later groups; order matters
    assert got == ["data_science", "machine_learning", "iot", "other", "other", "web_framework", "iot"]


def test_path_purpose_and_extension(spark):
    paths = ["a.b/c", "README", "x/tests/t.py", ".github/w.yml", "a/b/c/d.py", "pkg/src/m.py", "a/b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(C.file_extension("p").alias("e"), C.path_purpose("p").alias("u")).collect()
    assert [r.e for r in rows] == ["b/c", "none", "py", "yml", "py", "py", "none"]
    assert [r.u for r in rows] == ["root_or_meta", "root_or_meta", "testing", "configuration", "other",
                                   "source", "root_or_meta"]


def test_commit_time_utc(spark):
    df = spark.createDataFrame([("2021-03-01T10:00:00+02:00",), ("2021-03-01 10:00:00",), ("nonsense",)], "s string")
    ts = C.parse_commit_time("s")
    rows = df.select(C.commit_hour(ts).alias("h"), C.commit_weekday(ts).alias("d")).collect()
    # 2021-03-01 is a Monday -> 0
    assert [(r.h, r.d) for r in rows] == [(8, 0), (10, 0), (0, 0)]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 12),)], "t timestamp")   # a Sunday
    assert df.select(C.commit_weekday("t")).first()[0] == 6


def test_date_forms_in_any_session_zone(spark):
    texts = {"2021-03-01T10:00:00+02:00": (8, 0), "2021-03-01 10:00:00": (10, 0), "2021-03-01": (0, 0),
             "2021-03-01T10:00:00Z": (10, 0), "2021-03-01 10:00:00.5+0530": (4, 0), "2021-03-01T01:00:00+02:00": (23, 6),
             "Mon, 01 Mar 2021 10:00:00 +0200": (8, 0), "1 Mar 2021 10:00 GMT": (10, 0),
             "Mon Mar 1 10:00:00 2021 +0200": (8, 0), "Mon Mar  1 10:00:00 2021": (10, 0),
             "Mon, 01 Foo 2021 10:00:00 +0200": (0, 0), "": (0, 0), "99": (0, 0), "nonsense": (0, 0), None: (0, 0)}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(t,) for t in texts], "s string")
            ts = C.parse_commit_time("s")
            rows = df.select("s", C.commit_hour(ts).alias("h"), C.commit_weekday(ts).alias("d")).collect()
            assert {r.s: (r.h, r.d) for r in rows} == texts, zone
            ntz = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-07 23:30:00' AS t")
            ts = C.ensure_timestamp(ntz, "t")
            assert tuple(ntz.select(C.commit_hour(ts), C.commit_weekday(ts)).first()) == (23, 6), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
