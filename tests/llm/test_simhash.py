import random
import re

import numpy as np
import xxhash

from changelens.llm import simhash
from changelens.llm.components import components
from common import DOC_SCHEMA, odd_documents, union_find, words


def _fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _check(spark, rows):
    got = simhash.simhash_dedup(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    cache = {r[1]: _fingerprint(r[1]) for r in rows}
    fps = sorted(set(cache.values()))
    codes = np.array(fps, np.uint64)
    pairs = [(a, int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(codes ^ codes[a]) <= 2)]
    root = union_find(len(fps), pairs)
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            r = root[fps.index(cache[t])]
            low[r] = min(i, low.get(r, i))
    expected = [(i, f"{cache[t]:016x}", low.get(root[fps.index(cache[t])])) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    return len(fps), len(set(root))


def test_odd_rows(spark):
    _check(spark, odd_documents())


def test_chains_and_hot_group(spark):
    """Near copies that link only through others, and a third of equal rows."""
    r = random.Random(5)
    base = words(400, 1)
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, " ".join(base), "en", "s", 1) for i in range(120)]
    distinct, groups = _check(spark, rows)
    assert groups < distinct


def test_index_finds_every_near_pair():
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 20, np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (20, 60, 3)).astype(np.uint64)
    codes = np.unique((centres[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ flips[..., 2]).ravel())
    members = codes[np.argsort(simhash._gray_rank_np(codes))]
    found = {(min(a, b), max(a, b)) for m, q in simhash.search(members, members, 2)
             for a, b in zip(m.tolist(), q.tolist()) if a != b}
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 2
    assert found == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))) if a < b}
    assert list(simhash.search(members[:0], members, 2)) == []
    ranks = np.sort(simhash._gray_rank_np(codes) >> np.uint64(11))
    trie = simhash.Trie(ranks[::10].tolist())
    q, leaf, diff = trie.walk(codes, 2)
    home = np.zeros(len(codes), int)
    at, own, _ = trie.walk(codes, 0)
    home[at] = own
    reach = set(zip(q.tolist(), leaf.tolist()))
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    assert all((x, home[y]) in reach for x, y in zip(a.tolist(), b.tolist()))


def test_keep_first(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS id")
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert 90 in kept and 95 not in kept and kept.count(None) == 2
    assert simhash.keep_first(df.limit(0)).collect() == []


def test_keep_first_tells_rows_of_an_id_apart(spark):
    a, b = "an own text that nothing else is like at all", "some other text of a few words more or less"
    rows = [(3, b), (5, a), (5, b), (7, None), (7, ""), (8, None)]
    kept = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept[:], key=str)[:2] == [(3, b), (5, a)] and sum(i == 7 for i, _ in kept) == 1 and len(kept) == 3


def test_components_of_random_links(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    pairs += [(500, 500 + i) for i in range(1, 100)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = union_find(700, [p for p in pairs if None not in p])
    linked = {x for a, b in pairs if None not in (a, b) and a != b for x in (a, b)}
    assert {k: got.get(k, k) for k in linked} == {k: root[k] for k in linked}
