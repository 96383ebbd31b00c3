import numpy as np
import pytest

from changelens.llm import embeddings
from common import union_find

SCHEMA = "vec_id long, embedding array<float>, label int"


def _vectors(n=700, dims=24, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32)
    x[n // 2:] = x[r.integers(0, 20, n - n // 2)] + r.normal(size=(n - n // 2, dims)).astype(np.float32) * 0.32
    x[-150:] = x[3]  # copies
    x[-20:] = x[3] * np.float32(2.5)
    return x


def _check(spark, x, extra=()):
    rows = [(int(i * 7 % 100003), v.tolist(), i % 3) for i, v in enumerate(x)]
    got = embeddings.near_vectors(spark.createDataFrame(rows + list(extra), SCHEMA), block_dims=8).collect()
    assert len(got) == len(rows) + len(extra)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    ids = [r[0] for r in rows]
    order = np.argsort(ids)
    place = {int(o): k for k, o in enumerate(order)}
    root = union_find(len(ids), [(place[a], place[b]) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)))])
    expected = {ids[i]: (int(near[i].sum()) - 1, ids[order[root[place[i]]]]) for i in range(len(ids))}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id in expected} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    return {r.vec_id: r for r in got}


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    _check(spark, _vectors())


def test_cells_in_slices(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 60)
    monkeypatch.setattr(embeddings, "PROBE_SLICE", 150)
    _check(spark, _vectors(seed=2))


def test_cells_with_too_many_members_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 20)
    monkeypatch.setattr(embeddings, "SAMPLE_ROWS", 3)        # three cells at most
    _check(spark, _vectors(seed=3))
    monkeypatch.setattr(embeddings, "PROBE_SLICE", 100)
    _check(spark, _vectors(seed=4))


def test_only_crowded_cells_are_cut(monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 10)
    monkeypatch.setattr(embeddings, "PROBE_SLICE", 50)
    plan = embeddings.Slices(np.array([8, 12, 95, 0]), np.array([0, 120, 10, 3]))
    assert plan.parts.tolist() == [1, 1, 10, 1] and plan.slices.tolist() == [1, 3, 3, 1]
    ids, home = np.arange(115), np.repeat([0, 1, 2], [8, 12, 95])
    row, number, role = plan.deal(ids, home, np.arange(20), np.full(20, 2))
    members = role > 0
    assert (np.bincount(row[members]) == plan.slices[home]).all()       # once a slice of its part
    assert (np.bincount(row[role == 2]) == 1).all()
    assert ((role == 0) & (row < 20)).sum() == 20 * 10                  # once a part of the visited cell
    part = (number - plan.start[2]) // 3
    part_of = {int(r): int(p) for r, p in zip(row[members], part[members]) if r >= 20}
    met = {(int(r), int(p)) for r, p in zip(row[role == 0], part[role == 0]) if r >= 20}
    assert set(part_of.values()) == set(range(10))
    assert met == {(r, p) for r, own in part_of.items() for p in range(own + 1, 10)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    extra = [(200001, None, 1), (200002, [], 1), (200003, [0.0] * 24, 1), (200004, [nan] + [1.0] * 23, 1),
             (200005, [inf] * 24, 1), (200006, [None] + [1.0] * 23, None), (200007, [0.0] * 24, 1)]
    got = _check(spark, _vectors(), extra)
    for i, *_ in extra:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (9, [2.0], 1)]
    got = sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(None, 0, None, True), (5, 3, 4, False), (5, 3, 4, False), (4, 3, 4, True), (9, 3, 4, False)],
                         key=repr)


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert embeddings.near_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 1
