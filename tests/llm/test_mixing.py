from collections import Counter

import numpy as np
import pytest

from changelens.llm import mixing
from common import DOC_SCHEMA, odd_documents, words


def test_rake_meets_targets():
    r = np.random.default_rng(1)
    tokens = r.integers(0, 1000, (4, 3, 2)).astype(float)
    share = [tokens.sum(axis=(1, 2)), tokens.sum(axis=(0, 2)), tokens.sum(axis=(0, 1))]
    share = [(s / s.sum()) ** 0.8 for s in share]
    share = [s / s.sum() for s in share]
    p = mixing.rake(tokens, share, 0.3)
    assert ((p >= 0) & (p < 1)).all()
    for axis, s in enumerate(share):
        got = (p * tokens).sum(axis=tuple(i for i in range(3) if i != axis))
        assert np.allclose(got, s * 0.3 * tokens.sum(), rtol=1e-6)


def test_rake_is_bounded_by_one():
    tokens = np.array([[100.0, 0], [1, 1]])
    p = mixing.rake(tokens, [np.array([0.5, 0.5]), np.array([0.5, 0.5])], 0.9)
    assert p.max() <= 1 and (mixing.rake(np.zeros((2, 2)), [np.zeros(2)] * 2, 0.5) <= 1).all()


def _documents():
    return [(i, " ".join(words(40 + i % 50, i)), "en" if i % 4 else "de", f"s{min(i % 10, 3)}", 1) for i in range(2000)]


def test_expected_and_drawn_shares(spark):
    df = spark.createDataFrame(_documents(), DOC_SCHEMA)
    wanted = {"source": {"s0": 0.3, "s1": 0.3}, "lang": {"de": 0.4, "en": 0.6}}
    out = mixing.mix(df, targets=wanted, budget=0.2, topics=2).collect()
    assert len(out) == 2000
    total = sum(r.tokens for r in out)
    assert all(r.tokens == len(t.split()) for r, (_, t, *_) in zip(sorted(out, key=lambda r: r.doc_id), _documents()))
    for axis, shares in wanted.items():
        for name, share in shares.items():
            rows = [r for r in out if r[axis] == name]
            assert abs(sum(r.tokens * r.probability for r in rows) / (0.2 * total) - share) < 0.01
            assert abs(sum(r.tokens * r.selected for r in rows) / (0.2 * total) - share) < 0.08
    again = mixing.mix(df.repartition(3), targets=wanted, budget=0.2, topics=2).collect()
    assert {r.doc_id for r in again if r.selected} == {r.doc_id for r in out if r.selected}


def test_topics_are_fitted_to_all_documents(spark):
    rows = [(i, " ".join(words(60, i)), "en", "s", 1) for i in range(600)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = mixing.fit_topics(df, topics=3, sample_rows=20, rounds=60)
    x = mixing._vectors(mixing.pa.array([r[1] for r in rows], mixing.pa.large_string()))
    near = (x @ got.T).argmax(axis=1)
    means = mixing._unit(np.stack([x[near == i].astype(float).sum(axis=0) for i in range(3)]))
    assert np.allclose(got, means, atol=1e-4)  # every centre is the mean of all its documents
    assert np.array_equal(got, mixing.fit_topics(df.repartition(7), topics=3, sample_rows=20, rounds=60))


def _brute_rake(cells, budget, wanted, temper):
    """Raking by the definition, over a dict of cells."""
    total = sum(cells.values())
    shares = []
    for i in range(3):
        seen = Counter()
        for c, n in cells.items():
            seen[c[i]] += n / total
        if i == 0:
            rest, free = 1 - sum(wanted.values()), sum(n for c, n in seen.items() if c not in wanted)
            share = {c: wanted.get(c, rest * n / free) for c, n in seen.items()}
        else:
            share = {c: n ** temper for c, n in seen.items()}
        shares.append({c: x / sum(share.values()) for c, x in share.items()})
    p = dict.fromkeys(cells, budget)
    for _ in range(300):
        for i in range(3):
            now = Counter()
            for c, n in cells.items():
                now[c[i]] += p[c] * n
            p = {c: min(1.0, x * shares[i][c[i]] * budget * total / now[c[i]]) for c, x in p.items()}
    return p


def test_many_sources_are_raked_each_on_its_own(spark, monkeypatch):
    rows = [(i, "a b c d " * (2 if i % 7 else 1), "en" if i // 300 % 4 else "de", f"s{i % 300:03d}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    centres = np.eye(1, mixing.TRIGRAMS, dtype=np.float32)
    wanted = {"s000": 0.008}
    cells = Counter()
    for _, t, lang, source, _ in rows:
        cells[source, lang, "0"] += len(t.split())
    want = _brute_rake(cells, 0.3, wanted, 0.7)
    for limit in (mixing.DRIVER_CELLS, 10):  # in the driver, and as a table
        monkeypatch.setattr(mixing, "DRIVER_CELLS", limit)
        out = mixing.mix(df, targets={"source": wanted}, budget=0.3, centres=centres).collect()
        assert all(abs(r.probability - want[r.source, r.lang, "0"]) < 1e-4 for r in out)
        share = sum(r.tokens * r.probability for r in out if r.source == "s000") / sum(r.tokens * 0.3 for r in out)
        assert abs(share - 0.008) < 1e-4


def test_unknown_targets_are_refused(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 1)], DOC_SCHEMA)
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mix(df, targets={"source": {"nowhere": 0.5}}, topics=1)


def test_counts_round_trip():
    counts = np.zeros((3, mixing.TRIGRAMS), np.int64)
    counts[0, 5], counts[1, 6], counts[2, 7] = 200, 3000, 1 << 20
    got = np.concatenate(list(mixing._unpacked(mixing.pa.array(mixing._packed(counts), mixing.pa.binary()))))
    assert np.allclose(got, mixing._unit(np.log1p(counts)))


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_documents(), DOC_SCHEMA).selectExpr("*", "1 AS tokens", "2 AS selected", "3 AS topic")
    out = mixing.mix(df)
    assert out.columns[:len(df.columns)] == df.columns and "selected_mix" in out.columns
    rows = out.collect()
    assert len(rows) == len(odd_documents())
    assert all(0 < r.probability <= 1 and r.tokens_mix >= 1 and r.selected_mix is not None for r in rows)
    twins = [r.selected_mix for r in rows if r.doc_id == 100]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert mixing.sample(df).columns == df.columns
    assert mixing.sample(df.limit(0)).collect() == []
