import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from changelens.llm import queries
from common import DOC_SCHEMA, odd_documents
from test_exact import _normal
from test_simhash import _fingerprint

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_contracts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SMALL).cache())
        assert kept[-1].dtypes == docs.dtypes, name
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    assert {i for i, r in rows[0].items() if not any(c.isalpha() for c in r.text or "")}.isdisjoint(rows[1])
    assert len(rows[1]) >= 0.95 * len(rows[0])
    least = {}
    for i, r in rows[1].items():
        least[_normal(r.text)] = min(i, least.get(_normal(r.text), i))
    assert set(rows[2]) == set(least.values())
    prints = [_fingerprint(r.text) for r in rows[3].values()]
    codes = np.array(prints, np.uint64)
    assert (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2).sum() == len(codes)
    assert 0.5 * len(rows[3]) < len(rows[4]) < len(rows[3])


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(*r, "x", 1.5, None) for r in odd_documents()] + [(3, "another text for an id that is there", "en", "s1", 1, "y", None, 7)]
    df = spark.createDataFrame(rows, DOC_SCHEMA + ", h string, topic double, id long")
    for docs in (df, df.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{docs is df}-{len(list(tmp_path.iterdir()))}")
            stage(spark, docs, SMALL).write.parquet(path)
            after = spark.read.parquet(path)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert after.dtypes == docs.dtypes, name
            docs = after
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in rows} and not ids & {101, 102, 103, 104}


def test_a_repeated_id_with_another_text_is_another_document(spark):
    a, b = "an own text that nothing else is like at all", "some other text of a few words more or less"
    docs = spark.createDataFrame([(3, b, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1)], DOC_SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL).cache()
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(3, b), (5, a)]


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for i, found in pieces.items():
        ids = np.array(tokenizer.encode(text[i], add_special_tokens=False).ids + [2], "<u4")
        found.sort(key=lambda r: r.start)
        assert sum(r.length for r in found) == len(ids)
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in found)


def test_folds_are_those_of_the_contract(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "doc_id long").select("doc_id", queries.fold(4).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in df.collect())
