import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from changelens.llm import alignment
from common import DOC_SCHEMA, odd_documents

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a <|endoftext|> b <s> </s> <0x41> ▁ x", "\nlead", " lead  two\ttabs\r\n", "日本語のテキスト🙂🙂 ñandú nbsp em",
       "x" * 3000, "▁a▁", "a\nb c\nd 日本 é", "🙂👩‍👩‍👧‍👦" * 300, "a<|endoftext|>b", "<0x41> <unk>", "'s 't we'll\nI'm",
       "\x00 nul", " ", "\n", "ends \n", "ǅ ﬁ Å", "1234567890 12 3.14e-10"]


def brute(docs):
    """The contract, read off both libraries one text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    alphabet, entries = alignment.byte_alphabet(), {i: t for t, i in a_side.get_vocab().items()}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    def ends(parts):
        return np.cumsum([len(x) for x in parts]).tolist()
    rows, counts = [], Counter()
    for doc, text in docs:
        linked, found, a, b = Counter(), [], [], []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            x, y = [bytes(alphabet[c] for c in entries[i]) for i in a], [piece(i) for i in b]
            if not b"".join(x) == b"".join(y) == (" " + text).encode():
                a = b = []
            else:
                ea, eb = ends(x), ends(y)
                i = j = 0
                for e in sorted(set(ea) & set(eb)):
                    left, right = [], []
                    while i < len(ea) and ea[i] <= e:
                        left.append(a[i])
                        i += 1
                    while j < len(eb) and eb[j] <= e:
                        right.append(b[j])
                        j += 1
                    found.append((left, right))
                    linked.update((p, q) for p in left for q in right)
        counts.update(linked.keys())
        rows.append((doc, len(a), len(b), found, linked))
    top = Counter()
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    return sorted([(d, na, nb, len(g), sum(x.values()), sum(n for p, n in x.items() if counts[p] == top[p[0]]),
                    sum(n * counts[p] for p, n in x.items()),
                    hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g).encode())
                    .hexdigest() if na else "") for d, na, nb, g, x in rows], key=str)


def _got(df):
    return sorted(map(tuple, alignment.align_corpus(df, A, B).collect()), key=str)


def test_odd_documents_against_brute_force(spark):
    rows = odd_documents() + [(200 + i, t, "", "", 0) for i, t in enumerate(ODD)]
    assert _got(spark.createDataFrame(rows, DOC_SCHEMA)) == brute([r[:2] for r in rows])


def test_given_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert _got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_many_blocks_share_counts(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(7)
    assert _got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table_and_clashing_columns(spark):
    assert _got(spark.createDataFrame([], DOC_SCHEMA)) == []
    df = spark.createDataFrame([(1, "one two", 5, "x"), (2, None, 6, "y")],
                               "doc_id long, text string, block long, pairs string")
    assert _got(df) == brute([(1, "one two"), (2, None)])


def test_links_are_those_of_the_groups(spark):
    text = "日本 naïve 🙂🙂 tokenization"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = alignment.links(df, A, B).collect()
    assert sum(r.times for r in got) == brute([(1, text)])[0][4] and {r.doc_id for r in got} == {1}


@pytest.mark.parametrize("seed", range(8))
def test_lockstep_against_sets_of_ends(seed):
    r = random.Random(seed)
    n = r.randrange(50, 4000)
    inner = sorted(r.sample(range(1, n), r.randrange(1, n - 1)))
    ends_a = np.array(sorted(set(r.sample(inner, len(inner) // 2)) | {n}))
    ends_b = np.array(sorted(set(r.sample(inner, len(inner) // 3)) | {n}))
    first_a, stop_a, first_b, stop_b = alignment.lanes(ends_a, ends_b, np.array([len(ends_a) - 1]), lane=16)
    assert stop_a[-1] == len(ends_a) and stop_b[-1] == len(ends_b)
    a, b, cuts = alignment.lockstep(ends_a, ends_b, first_a, stop_a, first_b)
    assert sorted(ends_a[a[cuts]]) == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    overlap = {(i, j) for i in range(len(ends_a)) for j in range(len(ends_b))
               if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]}
    assert len(a) == len(overlap) and set(zip(a.tolist(), b.tolist())) == overlap


def test_products_of_large_groups(monkeypatch):
    monkeypatch.setattr(alignment, "_LINKS", 50)
    r = np.random.default_rng(1)
    n_a, n_b = np.array([2, 30, 3, 1, 7]), np.array([2, 40, 2, 9, 5])
    ids_a, ids_b = r.integers(0, 9, n_a.sum()), r.integers(0, 6, n_b.sum())
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    got, want = Counter(), Counter()
    for parts in alignment._products(ids_a, ids_b, first_a, n_a, first_b, n_b):
        for g, x, y, t in zip(*(p.tolist() for p in parts)):
            got[g, x, y] += t
    for g in range(5):
        for x in ids_a[first_a[g]:first_a[g] + n_a[g]].tolist():
            for y in ids_b[first_b[g]:first_b[g] + n_b[g]].tolist():
                want[g, x, y] += 1
    assert got == want


def test_small_numbers_round_trip():
    for x in ([], [0, 255], [256, 1], [1 << 33, 5]):
        assert alignment._large(alignment._small(np.array(x, np.int64))).tolist() == x


def test_word_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WORDS", 20)
    pair = alignment.Pair(A, B)
    texts = [" ".join(f"word{i + j} x{j}" for j in range(9)) for i in range(30)]
    whole = [[pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)] for t in texts]
    for i in range(0, 30, 3):
        a, b = pair.encode(pa.array(texts[i:i + 3], pa.large_string()))
        assert [[x.tolist(), y.tolist()] for x, y in zip(a, b)] == whole[i:i + 3]
        assert len(pair.known) <= 60
