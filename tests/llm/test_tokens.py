import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from changelens.llm import packing, token_files
from changelens.llm.tokens import Encoder
from common import DOC_SCHEMA, odd_documents

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", "a", " a", "a b", "a  b", "a\nb", "a \nb", "a\n\nb", "\na", "a ", "a\n", "\n", " ", "it's don't 12 3,4.",
         "x <|endoftext|> y", "tab\tx", "nbsp x y", "É é é ΑΣ Σ ß", "a ́b", "日本 語", "\x01a b", "½ x", "a\r\nb"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    tokenizer, encoder = Tokenizer.from_file(P.path(name)), Encoder(P.path(name), 2)
    texts = TEXTS + [t or "" for _, t, *_ in odd_documents()]
    for _ in range(2):  # second time from the cache
        got = []
        for _, ids, lengths in encoder.encode(pa.array(texts, pa.large_string()), limit=3000):
            got += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("width", [1, 2, 7, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 5001).astype(np.uint32)
    packed = token_files.pack_ids(ids, width)
    assert len(packed) == -(-5001 * width // 64)
    assert (token_files.unpack_ids(packed, 5001, width) == ids).all()
    with pytest.raises(ValueError):
        token_files.pack_ids(np.array([1 << width], np.uint64), width)


def test_token_files_round_trip(spark, tmp_path):
    rows = odd_documents()
    name = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("*", "1 AS id", "2 AS shard")
    manifest = token_files.write_tokens(df, f"file://{tmp_path}/ids", name)
    got = token_files.read_tokens(manifest, at_once=5000).collect()
    tokenizer = Tokenizer.from_file(name)
    expected = {}
    for i, t, *_ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    found, start = defaultdict(list), 0
    for r in sorted(got, key=lambda r: r.start):  # no gap, ids ascending, null ids last
        assert r.start == start
        start += r.n_tokens
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is None, x or 0))
    shard = manifest.orderBy("shard").first()
    f = token_files.TokenFile(shard["path"])
    assert f.width == 16
    assert (np.concatenate([f.ids(0, 5), f.ids(5, f.n_ids)]) == f.ids(0, f.n_ids)).all()
    empty = token_files.write_tokens(df.limit(0), f"file://{tmp_path}/none", name)
    assert token_files.read_tokens(empty).collect() == []


def _check_packing(spark, rows, **params):
    name = P.path("word_bpe_49k.json")
    df = spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("*", "1 AS id", "2 AS start")
    got = packing.pack(df, name, with_ids=True, **params).collect()
    tokenizer = Tokenizer.from_file(name)
    docs, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in got:
        assert len(r.ids) == r.length > 0
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        steps[r.step_group] += r.length
    expected = defaultdict(list)
    for i, t, *_ in rows:
        expected[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    assert set(docs) == set(expected)
    for i, texts in expected.items():
        if len(texts) == 1:
            pieces = sorted(docs[i], key=lambda r: r.start)
            assert sum((r.ids for r in pieces), []) == texts[0]
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
            assert {r.doc_tokens for r in pieces} == {len(texts[0])}
        else:
            assert sum(r.length for r in docs[i]) == sum(map(len, texts))
    sizes = []
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        sizes.append(end)
        assert end <= 4096 and end & (end - 1) == 0  # so none is padded
    return sizes, steps


def test_packing(spark):
    sizes, _ = _check_packing(spark, odd_documents())
    assert sizes.count(4096) > 10


def test_packing_over_many_blocks(spark, monkeypatch):
    rows = [(i, " ".join(["word"] * (37 * i % 900)), "en", "s", 1) for i in range(150)]
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 8000)
    _check_packing(spark, rows, step_tokens=8192)


def test_blocks_are_packed_whole_and_balanced():
    docs = [(i, 0, 1 + 911 * i % 7000) for i in range(400)]
    windows, rest = packing.pack_block(docs, packing.TIERS, False)
    pieces = sorted(p for w in windows for p in w) + rest
    assert sum(p[2] for p in pieces) == sum(d[2] for d in docs)
    assert all(sum(p[2] for p in w) in packing.TIERS for w in windows)
    assert sum(p[2] for p in rest) < 2 * packing.TIERS[-1]
    sizes = [sum(p[2] for p in w) for w in windows]
    load = defaultdict(int)
    for s, g in zip(sizes, packing.balance(sizes, 1 << 16)):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 4096


def test_no_documents(spark):
    df = spark.createDataFrame([], DOC_SCHEMA)
    assert packing.pack(df, P.path("word_bpe_49k.json")).collect() == []
