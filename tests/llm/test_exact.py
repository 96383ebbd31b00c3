import hashlib
import re
from collections import defaultdict

from changelens.llm.exact import exact_dedup, keep_first
from common import DOC_SCHEMA, odd_documents


def _normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _check(spark, rows):
    got = exact_dedup(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_normal(r[1])].append(r[0])
    expected = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        for place, i in enumerate(ids):
            expected.append((i, ids[0], len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[4], r[0] is None, r[0] or 0, not r[3])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_odd_rows(spark):
    _check(spark, odd_documents())


def test_hot_text_is_cut_into_runs(spark):
    """A text with a third of all rows, and with null ids among them."""
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i // 2}", "en", "s", 1) for i in range(900)]
    rows += [(None, "hot text " * 20, "en", "s", 1)] * 5
    _check(spark, rows)


def test_keep_first_returns_whole_rows_once(spark):
    df = spark.createDataFrame(odd_documents(), DOC_SCHEMA).selectExpr("*", "1 AS run", "2 AS norm", "3 AS id", "4 AS kept")
    out = keep_first(df)
    assert out.columns == df.columns
    rows = out.collect()
    texts = [_normal(r.text) for r in rows]
    assert len(texts) == len(set(texts)) == len({_normal(r[1]) for r in odd_documents()})
    assert {r.doc_id for r in rows if _normal(r.text) == "same text here"} == {90}


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
