import random

import numpy as np
import pyarrow as pa

from changelens.llm import features, quality
from common import DOC_SCHEMA, odd_documents, words


def _labelled():
    r = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        w = words(80, i)
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" if i % 8 else x + r.choice(["###", "$$$", "&&&"]) for x in w]
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _labelled()
    df = spark.createDataFrame(docs, DOC_SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    model = quality.train(df, known, per_class=100, dims=16)
    truth = {i: q for i, q, _ in labels}
    got = quality.score(df, model).collect()
    held = [r for r in got if r.doc_id % 3 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_odd_rows_and_labels(spark):
    df = spark.createDataFrame(odd_documents(), DOC_SCHEMA).selectExpr("*", "1 AS score", "2 AS label", "3 AS x")
    labels = [(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, None, 1), (5, 7, 0), (4, 0, 0), (4, 1, 0)]
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dims=8)
    got = quality.score(df, model).collect()
    assert len(got) == len(odd_documents())
    prior = float(model.labels.mean())
    assert all(r.score == prior for r in got if r.doc_id in (101, 102))
    nothing = quality.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(df, nothing).collect()} == {0.5}
    assert quality.score(df.limit(0), model).collect() == []


def test_vote_against_brute_force():
    r = np.random.default_rng(0)
    basis = np.eye(quality.WIDTH, 5, dtype=np.float32)
    refs = r.normal(size=(30, 5)).astype(np.float32)
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    labels = r.integers(0, 2, 30).astype(np.float32)
    model = quality.Model(np.ones(quality.WIDTH), basis, refs, labels)
    x = np.zeros((600, quality.WIDTH), np.float32)
    x[:, :5] = r.normal(size=(600, 5))
    got = quality.vote(x, model, 7, 10.0)
    for i in (0, 511, 512, 599):
        cos = refs @ (x[i, :5] / np.linalg.norm(x[i, :5]))
        top = np.argsort(-cos)[:7]
        w = np.exp(10.0 * (cos[top] - 1))
        assert abs(got[i] - (w * labels[top]).sum() / w.sum()) < 1e-4


def test_document_frequencies_cover_all_rows(spark):
    df = spark.createDataFrame(odd_documents(), DOC_SCHEMA).repartition(5)
    n, seen = quality.document_frequencies(df, "text")
    one = quality.counts(pa.array([r[1] or "" for r in odd_documents()], pa.large_string()))
    assert n == len(odd_documents()) and (seen == (one > 0).sum(axis=0)).all()


def test_word_shapes():
    texts = ["", "Hello hello WORLD, a1 ##", " x x  x\n"]
    data, bounds = features.raw(pa.array(texts, pa.large_string()))
    first, end, doc = features.words(data, bounds)
    raw = b"".join(t.encode() for t in texts)
    assert [raw[a:b].decode() for a, b in zip(first, end)] == [w for t in texts for w in t.split()]
    shape = features.shapes(data, bounds)
    assert shape.sum(axis=1).tolist() == [0, 5, 3]
    assert shape[:, features.SHAPES // 2:].sum(axis=1).tolist() == [0, 0, 2]  # words like the one before
