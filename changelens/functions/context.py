"""Context features (D1-D8): time, path, repository domain, cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# Repository-name substrings -> domain, checked in this order;
# the first group with a matching substring wins, else "other".
REPO_DOMAINS = [
    (["lightning", "jax", "transformers", "ray", "scikit-learn", "spacy", "yolov5"], "machine_learning"),
    (["ansible", "airflow"], "automation"),
    (["celery"], "task_queue"),
    (["openpilot"], "autonomous_driving"),
    (["django", "django-rest-framework"], "web_framework"),
    (["freqtrade"], "trading"),
    (["core"], "iot"),
    (["numpy", "pandas", "redash"], "data_science"),
    (["pipenv", "poetry", "black"], "development"),
    (["scrapy"], "web_scraping"),
    (["sentry"], "logging"),
]

# Path substrings -> purpose, checked in this order.
PATH_PURPOSES = [
    (["/test", "/tests", "/__tests__", "/unittest"], "testing"),
    (["/doc", "/docs", "/documentation"], "documentation"),
    (["/example", "/examples", "/demo"], "examples"),
    (["/util", "/utils", "/helpers"], "utilities"),
    (["/config", "/configs", ".github", ".circleci", "/ci"], "configuration"),
    (["/src"], "source"),
]


def _first_match(value: Column, rules, default: Column) -> Column:
    out = default
    for subs, label in reversed(rules):
        cond = None
        for s in subs:
            e = T.contains(value, s)
            cond = e if cond is None else (cond | e)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def repo_domain(repo) -> Column:
    """D6.  A null repository maps to 'other' (only that row)."""
    low = F.lower(T.as_col(repo))
    return F.when(low.isNull(), F.lit("other")).otherwise(
        _first_match(low, REPO_DOMAINS, F.lit("other")))


def path_purpose(path) -> Column:
    """First matching rule, then depth <= 2 slashes -> root_or_meta."""
    low = F.lower(T.as_col(path))
    fallback = F.when(T.count_sub(low, "/") <= 2, F.lit("root_or_meta")).otherwise(F.lit("other"))
    return _first_match(low, PATH_PURPOSES, fallback)


# Date texts beyond ISO 8601, as patterns that give day, month, year, time, zone.
_MAIL_DATE = (r"^(?:[A-Za-z]{3},? +)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}:\d{2}(?::\d{2})?) *"
              r"(Z|GMT|UTC|[+-]\d{2}:?\d{2})?$", (1, 2, 3, 4, 5))
_GIT_DATE = (r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (\d{4}) *(Z|GMT|UTC|[+-]\d{2}:?\d{2})?$",
             (2, 1, 4, 3, 5))
_ISO_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?| UTC| GMT)$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _iso_zone(zone: Column) -> Column:
    """'+0200', 'GMT' or nothing as an ISO offset."""
    return F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))) \
        .when(zone.rlike(r"^[+-]\d{2}:\d{2}$"), zone).otherwise(F.lit("+00:00"))


def _written_date(c: Column, pattern: str, places: tuple) -> Column:
    """ISO text of a date with a month name; NULL for other months."""
    day, month, year, time, zone = (F.regexp_extract(c, pattern, i) for i in places)
    number = F.position(F.lower(month), F.lit(_MONTHS))
    time = F.when(F.length(time) <= 5, F.concat(time, F.lit(":00"))).otherwise(time)
    return F.when(number % 3 == 1, F.concat(
        year, F.lit("-"), F.lpad(((number + 2) / 3).cast("int").cast("string"), 2, "0"), F.lit("-"),
        F.lpad(day, 2, "0"), F.lit("T"), F.lpad(time, 8, "0"), _iso_zone(zone)))


def parse_commit_time(c) -> Column:
    """The instant of a date text, whatever the session's time zone.
    ISO 8601, mail (RFC 2822) and git forms; offsets are applied, texts
    without one are UTC.  Unparseable -> NULL."""
    c = F.trim(T.as_col(c))
    day_only = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    zoned = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(day_only, F.concat(c, F.lit("T00:00:00+00:00"))).when(
        c.rlike(r"\d:\d{2}.*" + _ISO_ZONE), F.when(c.rlike(r"[+-]\d{4}$"), zoned).otherwise(c)).otherwise(
        F.concat(c, F.lit("+00:00")))
    text = (F.when(c.rlike(_MAIL_DATE[0]), _written_date(c, *_MAIL_DATE))
            .when(c.rlike(_GIT_DATE[0]), _written_date(c, *_GIT_DATE)).otherwise(iso))
    return F.try_to_timestamp(text)


def _utc_hours(ts) -> Column:
    return F.floor(F.unix_seconds(T.as_col(ts)) / 3600)


def hour_or_null(ts) -> Column:
    return F.pmod(_utc_hours(ts), F.lit(24)).cast("int")


def weekday_or_null(ts) -> Column:
    """Monday = 0; 1970-01-01 was a Thursday."""
    return F.pmod(F.floor(_utc_hours(ts) / 24) + 3, F.lit(7)).cast("int")


def commit_hour(ts) -> Column:
    """Hour in UTC of an instant; 0 when it is missing or unparseable."""
    return F.coalesce(hour_or_null(ts), F.lit(0))


def commit_weekday(ts) -> Column:
    """D3: weekday in UTC of an instant; 0 when it is missing or unparseable."""
    return F.coalesce(weekday_or_null(ts), F.lit(0))


def path_length(path) -> Column:
    """D4."""
    return F.length(T.as_col(path))


def file_extension(path) -> Column:
    """Text after the last '.', dots in directories included; else 'none'."""
    p = T.as_col(path)
    return F.when(T.contains(p, "."), F.substring_index(p, ".", -1)).otherwise(F.lit("none"))


def clean_code(c) -> Column:
    """Drop '#...' to end of line, strip lines, drop blank ones, join with \\n."""
    c = T.as_col(c)
    # the regex only runs on texts that contain a '#'
    no_comments = F.when(T.contains(c, "#"), F.regexp_replace(c, "#[^\\n]*", "")).otherwise(c)
    kept = F.filter(F.transform(T.lines(no_comments), T.strip), lambda l: l != F.lit(""))
    return F.array_join(kept, "\n")


def ensure_timestamp(df, col: str):
    """The commit time column as an instant: texts are parsed, times without
    a zone are UTC."""
    kind = df.schema[col].dataType
    if isinstance(kind, StringType):
        return parse_commit_time(col)
    if kind.typeName() in ("timestamp_ntz", "date"):
        return parse_commit_time(F.date_format(F.col(col).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.col(col).cast("timestamp")
