"""Embedding near-dedup (7): subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation, so their length spreads
evenly over the axes, and split into blocks of ``block_dims`` axes.  Cosine
>= c means a squared distance of at most 2 - 2c, so in at least one block it
is within that block's proportional share.  Each block is range-joined: cells
are the leaves of a k-d tree (planes from a bounded sample; they only balance
the work), every vector is a member of its own cell and is sent as a probe to
later cells whose box is within the budget.  Members and probes are counted per
cell first, without vectors: a cell with too many members is cut into parts,
whose members are probes of the later parts, and only a part with too many
probes is cut into slices, each with the part's members.  Within a slice, blocked products
find the pairs within budget; a pair counts in the first block that finds it
and is then verified exactly in double precision.  A task returns link counts
per vector and a spanning forest of its links, never the pairs.

Equal vectors are one row with a multiplicity all the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import forest
from .storage import cut

CELL_ROWS = 4096      # members a cell should have
FULL_CELLS = 4        # a cell of more than so many times that is cut into parts
PROBE_SLICE = 1 << 18
SAMPLE_ROWS = 16384
_SLACK = 1 + 1e-9


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Blocks:
    """Rotation, block bounds and budgets, and a k-d tree of cells per block."""

    def __init__(self, dims: int, block_dims: int, threshold: float):
        self.dims = dims
        self.rotation = rotation(dims)
        n = max(1, dims // block_dims)
        self.cuts = [dims * i // n for i in range(n + 1)]
        self.budgets = np.array([(2 - 2 * threshold) * (b - a) / dims * _SLACK
                                 for a, b in zip(self.cuts, self.cuts[1:])])
        self.trees: list[Tree] = []

    def turn(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit vectors, rotated unit vectors) in double precision."""
        x = vectors.astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return x, x @ self.rotation

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distance of rotated vectors, pair by pair, per block."""
        return np.stack([((a[:, s:e] - b[:, s:e]) ** 2).sum(axis=1)
                         for s, e in zip(self.cuts, self.cuts[1:])], axis=1)


class Tree:
    """Boxes of a k-d tree; ``walk`` prunes those beyond the budget."""

    def __init__(self, x: np.ndarray, cells: int):
        self.axis, self.value, self.child, self.low, self.high, self.leaves = [], [], [], [], [], 0
        self._grow(x, cells, np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf))
        self.axis, self.value = np.array(self.axis), np.array(self.value)
        self.child, self.low, self.high = np.array(self.child), np.array(self.low), np.array(self.high)

    def _grow(self, x, cells, low, high):
        at = len(self.axis)
        for part, v in ((self.axis, 0), (self.value, 0.0), (self.child, (-1, self.leaves)), (self.low, low),
                        (self.high, high)):
            part.append(v)
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        if cells <= 1 or len(x) < 2 or spread.max() == 0:
            self.leaves += 1
            return at
        axis = int(spread.argmax())
        value = float(np.median(x[:, axis]))
        right = x[:, axis] > value
        if not right.any():  # many equal to the largest
            right = x[:, axis] == value
            value = float(x[~right, axis].max())
        self.axis[at], self.value[at] = axis, value
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = value
        self.child[at] = (self._grow(x[~right], cells // 2, low, below),
                          self._grow(x[right], cells - cells // 2, above, high))
        return at

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.child[node, 0] >= 0)
            if not len(inner):
                return self.child[node, 1]
            at = node[inner]
            node[inner] = self.child[at, (x[inner, self.axis[at]] > self.value[at]).astype(int)]

    def walk(self, x: np.ndarray, budget: float):
        """(row, leaf) for all boxes within ``budget`` (squared) of a row."""
        q, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(q):
            leaf = self.child[node, 0] < 0
            out.append((q[leaf], self.child[node[leaf], 1]))
            q, node = q[~leaf], node[~leaf]
            q, node = np.concatenate((q, q)), np.concatenate((self.child[node, 0], self.child[node, 1]))
            gap = np.maximum(np.maximum(self.low[node] - x[q], x[q] - self.high[node]), 0)
            near = (gap ** 2).sum(axis=1) <= budget * _SLACK
            q, node = q[near], node[near]
        return [np.concatenate(c) for c in zip(*out)]


def _matrix(column, dims: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _near_pairs(members: np.ndarray, probes: np.ndarray, budget: float, own: bool):
    """Index pairs within ``budget`` in one block, tile by tile (a superset by
    the rounding of single precision)."""
    def widened(x, sign):
        x = x.astype(np.float32)
        square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)
        return np.hstack((x, square, one)) if sign else np.hstack((-2 * x, one, square))
    a, b = widened(members, True), widened(probes, False)
    for at in range(0, len(b), 1024):
        tile = b[at:at + 1024] @ a[:at + 1024 if own else len(a)].T
        p, m = np.nonzero(tile <= budget + 1e-5)
        p += at
        if own:
            p, m = p[m < p], m[m < p]
        yield m, p


class Slices:
    """Numbers for the slices of all cells of one block, from the counts of
    their members and probes."""

    def __init__(self, members: np.ndarray, probes: np.ndarray):
        self.parts = np.maximum(1, np.where(members > FULL_CELLS * CELL_ROWS, -(-members // CELL_ROWS), 1))
        probes = probes + np.where(self.parts > 1, members, 0)
        self.slices = np.maximum(1, -(-probes // PROBE_SLICE))
        self.start = np.cumsum(self.parts * self.slices) - self.parts * self.slices

    @staticmethod
    def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i repeated sizes[i] times, 0 .. sizes[i] - 1 for each i)."""
        at = np.repeat(np.arange(len(sizes)), sizes)
        return at, np.arange(len(at)) - (np.cumsum(sizes) - sizes)[at]

    def deal(self, ids: np.ndarray, home: np.ndarray, q: np.ndarray, leaf: np.ndarray):
        """(row, slice number, role) of members and probes; ``q`` visits ``leaf``.
        Members are in each slice of their part (role 2 in the first, else 1); a
        probe (0) is in one slice of each part of the cell, a member in one of
        each later part of its own."""
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = (mixed % self.parts[home].astype(np.uint64)).astype(np.int64)
        row, piece = self._ranges(self.slices[home])
        where = [(row, (self.start[home] + part * self.slices[home])[row] + piece, np.where(piece == 0, 2, 1))]
        for rows, cell, least in ((q, leaf, np.zeros(len(q), np.int64)), (np.arange(len(home)), home, part + 1)):
            at, later = self._ranges(self.parts[cell] - least)
            rows, cell, later = rows[at], cell[at], later + least[at]
            piece = ((mixed[rows] >> np.uint64(8)) % self.slices[cell].astype(np.uint64)).astype(np.int64)
            where.append((rows, self.start[cell] + later * self.slices[cell] + piece, np.zeros(len(rows), np.int64)))
        return [np.concatenate(x) for x in zip(*where)]


def _visits(blocks: Blocks, turned: np.ndarray):
    """Per block: each row's own cell, and (row, later cell) within budget."""
    for tree, budget, s, e in zip(blocks.trees, blocks.budgets, blocks.cuts, blocks.cuts[1:]):
        home = tree.home(turned[:, s:e])
        q, leaf = tree.walk(turned[:, s:e], budget)
        later = leaf > home[q]
        yield home, q[later], leaf[later]


def cell_counts(classes: DataFrame, sent) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block: members and probes of each cell (at most ``SAMPLE_ROWS`` cells
    a block, so the counts fit the driver)."""
    def count(batches):
        bl = sent.value
        totals = [np.zeros((2, t.leaves), np.int64) for t in bl.trees]
        for b in batches:
            turned = bl.turn(_matrix(b.column("vector"), bl.dims))[1]
            for total, (home, _, leaf) in zip(totals, _visits(bl, turned)):
                total += np.stack((np.bincount(home, minlength=total.shape[1]),
                                   np.bincount(leaf, minlength=total.shape[1])))
        for i, (members, probes) in enumerate(totals):
            cell = np.flatnonzero(members + probes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), i, np.int64)), pa.array(cell), pa.array(members[cell]),
                 pa.array(probes[cell])], ["block", "cell", "members", "probes"])
    found = (classes.select("vector").mapInArrow(count, "block long, cell long, members long, probes long")
             .groupBy("block", "cell").agg(F.sum("members").alias("members"), F.sum("probes").alias("probes"))).toArrow()
    out = [(np.zeros(t.leaves, np.int64), np.zeros(t.leaves, np.int64)) for t in sent.value.trees]
    for block, cell, members, probes in zip(*(found.column(c).to_pylist() for c in ("block", "cell", "members", "probes"))):
        out[block][0][cell], out[block][1][cell] = members, probes
    return out


def _cell_links(blocks: Blocks, threshold: float, chunk: int = 1 << 16):
    def run(table: pa.Table) -> pa.Table:
        block = int(table.column("cell")[0].as_py()) % len(blocks.budgets)
        ids, mult = table.column("id").to_numpy(), table.column("mult").to_numpy()
        role = table.column("role").to_numpy()
        x, turned = blocks.turn(_matrix(table.column("vector"), blocks.dims))
        s, e = blocks.cuts[block], blocks.cuts[block + 1]
        links = np.zeros(len(ids), np.int64)
        mine, others = np.flatnonzero(role > 0), np.flatnonzero(role == 0)

        def verified():
            # pairs of members count in their part's first slice only
            for rows, same in ([(mine, True)] if (role == 2).any() else []) + [(others, False)]:
                for m, p in _near_pairs(turned[mine, s:e], turned[rows, s:e], blocks.budgets[block], same):
                    for at in range(0, len(m), chunk):
                        a, b = mine[m[at:at + chunk]], rows[p[at:at + chunk]]
                        first = (blocks.distances(turned[a], turned[b]) <= blocks.budgets)
                        new = first[:, block] & ~first[:, :block].any(axis=1)
                        a, b = a[new], b[new]
                        hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                        a, b = a[hit], b[hit]
                        np.add.at(links, a, mult[b])
                        np.add.at(links, b, mult[a])
                        yield a, b
        low = forest(len(ids), verified())
        moved, linked = np.flatnonzero(low != np.arange(len(low))), np.flatnonzero(links)
        return pa.table({"a": np.concatenate((ids[linked], ids[moved])),
                         "b": pa.array(np.concatenate((ids[linked], ids[low[moved]]))),
                         "n": np.concatenate((links[linked], np.zeros(len(moved), np.int64)))})
    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                 block_dims: int = 16) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links`` (other vectors with cosine
    >= threshold), ``component_id`` (smallest id reachable by links, itself
    included) and ``kept`` (it is that id).

    Defined cases: vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing; a
    shorter vector counts as ending in zeros; repeated rows each get a row and
    link with one another; an empty table gives an empty result."""
    spark = df.sparkSession
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = (F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False))
            & F.exists(v, lambda c: c != 0))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("vector"))
    classes = cut(rows.where(F.col("vector").isNotNull()).groupBy("vector")
                  .agg(F.min("id").alias("low"), F.count("*").alias("mult")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size["n"]:
        return df.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"),
                         F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    blocks = Blocks(size["dims"], block_dims, threshold)
    cells = max(1, round(size["n"] / CELL_ROWS))
    if cells > 1:
        fit = (classes.select("vector", F.xxhash64("low").alias("h")).orderBy("h").limit(SAMPLE_ROWS)
               .select("vector").toArrow())
        turned = blocks.turn(_matrix(fit.column("vector"), blocks.dims))[1]
        blocks.trees = [Tree(turned[:, s:e], cells) for s, e in zip(blocks.cuts, blocks.cuts[1:])]
    else:
        blocks.trees = [Tree(np.zeros((0, e - s)), 1) for s, e in zip(blocks.cuts, blocks.cuts[1:])]
    sent = spark.sparkContext.broadcast(blocks)
    plans = [Slices(*c) for c in cell_counts(classes, sent)]
    vector_type = classes.schema["vector"].dataType.simpleString()

    def deal(batches):
        bl = sent.value
        for b in batches:
            turned = bl.turn(_matrix(b.column("vector"), bl.dims))[1]
            ids = b.column("low").to_numpy()
            for i, (plan, visits) in enumerate(zip(plans, _visits(bl, turned))):
                at, number, role = plan.deal(ids, *visits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number * len(plans) + i), pa.array(ids[at]), b.column("mult").take(pa.array(at)),
                     pa.array(role.astype(np.int8)), b.column("vector").take(pa.array(at))],
                    ["cell", "id", "mult", "role", "vector"])
    dealt = classes.mapInArrow(deal, f"cell long, id long, mult long, role byte, vector {vector_type}")
    found = cut(dealt.groupBy("cell").applyInArrow(_cell_links(blocks, threshold), "a long, b long, n long"), "found")
    roots = components(found.where("a <> b"), "a", "b")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    known = (classes.join(counts, classes["low"] == counts["a"], "left")
             .join(roots, classes["low"] == roots["node"], "left")
             .select(F.col("vector").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                     F.coalesce("root", "low").alias("component_id")))
    out = rows.join(known, rows["vector"] == known["of"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

