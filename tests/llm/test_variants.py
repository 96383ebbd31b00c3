import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from changelens.llm import variants
from common import DOC_SCHEMA, odd_documents


def brute(docs, least=7, occurrences=2, ratio=10, every=31):
    """The contract; near words by their texts with one place left out."""
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= occurrences}
    near, holes = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w in n:
        if near[w]:
            most, first = min((-n[x], x) for x in near[w])
            if -most >= ratio * n[w]:
                form[w] = first
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def _got(df, **params):
    return sorted(tuple(r) for r in variants.spelling_variants(df, **params).collect())


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)


def test_given_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = _got(df)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert sum(r[1] is not None for r in got) > 100


@pytest.mark.parametrize("params", [{}, {"crowd": 3}, {"parts": 4, "pieces": 2}, {"every": 2, "least": 3, "ratio": 2}])
def test_random_words_against_brute_force(spark, params):
    r = random.Random(len(params))
    words = ["".join(r.choice("abÀé") for _ in range(r.randint(6, 9))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words[:40 + 260 * (i % 2)]) for _ in range(60))) for i in range(80)]
    contract = {k: v for k, v in params.items() if k not in ("crowd", "parts", "pieces")}
    assert _got(_documents(spark, rows), **params) == brute(rows, **contract)


def test_chains_of_forms(spark):
    rows = [(0, "spellinh " * 2), (1, "spelling " * 30), (2, "spewling " * 400), (3, "spexling " * 5000),
            (4, None), (5, ""), (None, "spexlingg spexlingg"), (None, "spexlingg")]
    got = {r[0]: r for r in _got(_documents(spark, rows), every=10**9)}
    assert got["spellinh"][1:3] == ("spelling", "spexling")
    assert got["spelling"][1:3] == ("spexling", "spexling")  # two near words; the more frequent one
    assert got["spexling"][1:3] == (None, "spexling") and got["spexlingg"][2] == "spexling"


def test_ties_go_to_the_smallest_word(spark):
    rows = [(0, "aaaaaaab " * 2 + "aaaaaaac " * 20 + "aaaaaaad " * 20)]
    assert {r[0]: r[1] for r in _got(_documents(spark, rows), every=10**9)}["aaaaaaab"] == "aaaaaaac"


def test_odd_documents_and_columns(spark):
    rows = odd_documents() + [(300, "Zeichenkette zeichenkette " * 3, "", "", 0), (301, "y" * 30000 + " " + "y" * 30000, "", "", 0),
                              (302, "y" * 29999 + " " + "y" * 29999, "", "", 0), (303, "×÷×÷×÷×÷ ×÷×÷×÷×÷", "", "", 0),
                              (304, "àbcdefgh ÀÉÈÊËÌÍ àéèêëìí ÀÉÈÊËÌÍ", "", "", 0)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    assert _got(df) == brute([r[:2] for r in rows])
    assert _got(spark.createDataFrame([], DOC_SCHEMA)) == []
    assert _got(_documents(spark, [(1, "12 3"), (2, None)])) == []


def test_signatures_of_near_words_meet(spark):
    dealt = variants.deal({1: 5, 2: 5, 3: 4, 4: 1}, 3)
    assert sorted(dealt.values()) == [0, 1, 2, 2]
    label, word = variants.dimensions(pa.array(["abab", "b"]))
    found = [(int(x) // variants.LABELS, int(x) % variants.LABELS, int(w)) for x, w in zip(label, word)]
    assert sorted(found) == [(97, 0, 0), (97, 1, 0), (98, 0, 0), (98, 0, 1), (98, 1, 0)]


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    """The words' file is small; their keys are 18 rows a word."""
    spark.createDataFrame([(f"word{i}", 2) for i in range(50)], "word string, n long").write.parquet(f"{tmp_path}/w")
    words = spark.read.parquet(f"{tmp_path}/w")
    keys = variants._keys(variants.signatures(words), 3, 3)
    assert keys.count() == 18 * 50
    plan = variants._verified(keys)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
