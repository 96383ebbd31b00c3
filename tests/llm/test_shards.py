import zlib
from collections import Counter, defaultdict

import pytest

from changelens.llm import shards
from common import DOC_SCHEMA, odd_documents


def _check(df, k=16):
    got = shards.shard_documents(df, shards=k).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(want, key=str)
    slots, load, groups = defaultdict(list), Counter(), defaultdict(Counter)
    for r in got:
        assert 0 <= r.shard < k and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append((r.slot, r.doc_id))
        load[r.shard] += r.size
        groups[r.text_key][r.shard] += 1
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s)))
        ids = [-1 if x[1] is None else x[1] for x in s]
        assert ids == sorted(ids)
    return [load[i] for i in range(k)], {g: c for g, c in groups.items() if sum(c.values()) > 1}


def test_given_documents_stay_even_and_groups_whole(spark):
    load, groups = _check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert max(load) - min(load) <= 0.001 * sum(load) / 16
    assert groups and all(len(c) == 1 for c in groups.values())


def test_odd_documents(spark):
    docs = spark.createDataFrame(odd_documents(), DOC_SCHEMA)
    load, groups = _check(docs)
    assert all(len(c) == 1 for c in groups.values())
    # two texts are larger than an even part; the others fill the rest evenly
    rest = sorted(load)[:-2]
    assert rest[-1] - rest[0] <= 100


def test_empty_table(spark):
    assert shards.shard_documents(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_hot_group_is_spread_over_few_shards(spark):
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"{i} " * 21, None, None, None) for i in range(1200)]
    load, groups = _check(spark.createDataFrame(rows, DOC_SCHEMA), 8)
    assert max(load) - min(load) <= 0.01 * sum(load) / 8
    (spread,) = groups.values()
    assert sum(spread.values()) == 400 and len(spread) <= 5


def test_pairs_meet_even_if_no_document_is_free(spark):
    rows = [(i, f"pair {i // 2}", None, None, None) for i in range(1000)]
    load, groups = _check(spark.createDataFrame(rows, DOC_SCHEMA), 4)
    assert max(load) - min(load) <= 30
    assert sum(len(c) > 1 for c in groups.values()) <= 25


def test_rows_of_several_groups(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(64)], "row long, weight long")
    # two chains of overlapping groups
    links = [(i, i // 4) for i in range(32)] + [(i + 1, i // 4) for i in range(31)]
    members = spark.createDataFrame(sorted(set(links)), "row long, grp long")
    placed = shards.propagate(rows, members, 4)
    load = Counter(r.shard for r in placed.collect())
    assert sum(load.values()) == 64 and max(load.values()) == 16
    found = shards.cut_links(placed, members).first()
    by_group = defaultdict(list)
    for r, g in set(links):
        by_group[g].append(r)
    at = {r.row: r.shard for r in placed.collect()}
    pairs = [(a, b) for m in by_group.values() for a in m for b in m if a < b]
    assert found.links == len(pairs) and found["cut"] == sum(at[a] != at[b] for a, b in pairs)
    assert found["cut"] < 0.4 * found.links


def test_clashing_columns_and_carry(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, None), (None, None, None, "z")],
                               "doc_id long, text string, shard long, row string")
    got = shards.shard_documents(df, shards=2, carry=["shard", "row"]).collect()
    assert sorted(((r.doc_id, r.row.shard, r.row.row) for r in got), key=str) == sorted(
        [(1, 5, "x"), (2, 6, None), (None, None, "z")], key=str)
    assert {r.shard for r in got} <= {0, 1}


def test_no_python_on_the_main_path(spark):
    plan = shards.shard_documents(spark.createDataFrame(odd_documents(), DOC_SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("quota", [0, 7, 50, 10_000])
def test_prefix_fills_a_quota(spark, quota):
    rows = spark.createDataFrame([(0, i % 5, i % 11, 1 + i % 3) for i in range(200)],
                                 "by int, step int, fine int, weight long")
    quotas = spark.createDataFrame([(0, quota)], "by int, quota long")
    taken = sum(r.weight for r in shards._prefix(rows, quotas, ["by"]).collect())
    total = sum(1 + i % 3 for i in range(200))
    assert taken <= quota and (taken == total or quota - taken <= 12)
