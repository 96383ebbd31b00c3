"""Exact k nearest neighbours (B1) by pivot partitions.

1. A bounded number of points are pivots; every point belongs to the cell of
   its nearest pivot.  Cells near each other are bundled up to ``slice_rows``
   points; larger ones are cut into slices, so no group is unbounded.
2. The slices are written once to the shared folder, a file each.  A task takes
   points of one slice and finds in that slice an upper bound for the distance of
   each one's k-th neighbour (its radius).
3. It then reads, one at a time and the nearest first, the slices of bundles with a
   cell that can hold something within a point's radius, by the triangle inequality
   (the cell's inner and outer distance from its pivot) and by the bisecting plane
   between the two pivots.  What a slice holds nearer makes the radius smaller.
4. The k nearest of all that was visited are exact.

No point is copied or shuffled per visit, so disk grows with the points.  The work
depends on how well the data separates: in many dimensions of equal spread most
cells are within reach, and any exact search compares most pairs.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import scratch_folder

#: Pivots, at most; with the cells' figures they are sent to all tasks.
PIVOTS = 256
#: Points whose distances to a slice are held at once.
_BLOCK = 256
#: Points of a task, at least; as many as a slice holds at most.
_PROBES = 256
#: Rounding of distances must not lose a cell that just touches the radius.
_SLACK = 1e-9
log = logging.getLogger(__name__)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, summed in the
    order of the dimensions."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


class _Cells:
    """Pivots and, per cell, its size and nearest and farthest member."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.apart = np.sqrt(_squared(pivots, pivots))
        self.size = np.zeros(len(pivots), np.int64)
        self.inner, self.outer = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def home(self, x: np.ndarray):
        d = np.sqrt(_squared(x, self.pivots))
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(x)), cell]

    def reach(self, x: np.ndarray, cell: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
        """(points, cells): what each point must visit."""
        low, bound = self.bounds(x, cell, k)
        return low <= _roomy(np.minimum(radius, bound))[:, None]

    def bounds(self, x: np.ndarray, cell: np.ndarray, k: int):
        """(points, cells): how near a cell's members can be to each point, infinite
        or NaN where there is none to find; and how far the k-th neighbour is at most."""
        d = np.sqrt(_squared(x, self.pivots))
        # another upper bound: whole cells whose farthest member is near enough hold k others
        far = d + np.where(self.size > 0, self.outer, np.inf)
        order = far.argsort(axis=1)
        held = np.cumsum(self.size[order], axis=1) >= k + 1
        enough = np.where(held.any(axis=1), held.argmax(axis=1), far.shape[1] - 1)
        bound = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
        own = d[np.arange(len(x)), cell][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - own * own) / (2 * self.apart[cell])
        plane = np.where(self.apart[cell] > 0, plane, 0.0)
        with np.errstate(invalid="ignore"):
            low = np.maximum(np.maximum(d - self.outer, self.inner - d), plane)
        return np.where(self.size > 0, low, np.inf), bound


def _roomy(radius: np.ndarray) -> np.ndarray:
    """The radius with room for rounding."""
    return radius * (1 + _SLACK) + _SLACK


def _bundles(cells: _Cells, rows: int) -> np.ndarray:
    """A bundle per cell: cells of up to ``rows`` points in all, each next to one before."""
    out, left, last, held, number = np.zeros(len(cells.size), np.int64), set(range(len(cells.size))), 0, 0, 0
    while left:
        at = min(left, key=lambda c: (cells.apart[last, c], c))
        if held and held + cells.size[at] > rows:
            number, held = number + 1, 0
        out[at], held, last = number, held + cells.size[at], at
        left.remove(at)
    return out


def _candidates(x: np.ndarray, y: np.ndarray, code: np.ndarray, other: np.ndarray, m: int,
                most: np.ndarray | None = None):
    """(row, place) of at least the ``m`` nearest of ``y``, ties too, to each row of
    ``x``: squared distances by one matrix product, with room for its rounding.
    With ``most``, of those of them no farther than that (squared).  Rows of equal
    codes are the same."""
    sizes, others = (x * x).sum(axis=1), (y * y).sum(axis=1)
    plain = np.isfinite(sizes).all() and np.isfinite(others).all()
    room = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (sizes + others.max()) if plain else np.zeros(len(x))
    if plain and most is not None and np.isfinite(most).all():
        less = np.column_stack((x, np.ones(len(x)))) @ np.column_stack((-2 * y, others)).T
        row, place = np.nonzero(less <= (most + room - sizes)[:, None])
        differ = code[row] != other[place]
        return row[differ], place[differ]
    d = sizes[:, None] + others[None, :] - 2 * (x @ y.T) if plain else _squared(x, y)
    d[code[:, None] == other[None, :]] = np.inf
    limit = np.partition(d, m - 1, axis=1)[:, m - 1] + room
    return np.nonzero((d <= limit[:, None]) & np.isfinite(d))


def _nearest(ids, x, other_ids, y, k: int, most: np.ndarray | None = None):
    """(row of x, place in y, squared distance) of the k nearest other points,
    ties by id; those farther than ``most`` (squared) may be missing."""
    rank = np.argsort(np.argsort(np.asarray(other_ids, object), kind="stable"), kind="stable")
    names = {v: i for i, v in enumerate(dict.fromkeys(other_ids))}
    code, other = (np.fromiter((names.get(v, -1) for v in part), np.int64, len(part)) for part in (ids, other_ids))
    for at in range(0, len(x), _BLOCK):
        part = x[at:at + _BLOCK]
        row, place = _candidates(part, y, code[at:at + _BLOCK], other, min(k, len(y)),
                                 None if most is None else most[at:at + _BLOCK])
        d = np.zeros(len(row))
        for j in range(y.shape[1]):  # as ``_squared``
            d += (part[row, j] - y[place, j]) ** 2
        order = np.lexsort((rank[place], d, row))
        order = order[np.isfinite(d[order])]
        row, place, d = row[order], place[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < k
        yield at + row[keep], place[keep], d[keep]


class _Found:
    """The k nearest so far of each of ``n`` points."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.sq, self.nb = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.most = np.full(n, np.inf)  # squared distance of the k-th

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray) -> None:
        """See what ``y`` holds for the points ``rows``, whose vectors are ``x``."""
        found = list(_nearest(ids.tolist(), x, other_ids.tolist(), y, self.k, self.most[rows]))
        row, place, sq = (np.concatenate(v) for v in zip(*found))
        if not len(row):
            return
        row, sq, nb = (np.concatenate((a, b)) for a, b in ((self.row, rows[row]), (self.sq, sq), (self.nb, other_ids[place])))
        rank = {v: i for i, v in enumerate(sorted(set(nb.tolist())))}
        order = np.lexsort((np.fromiter((rank[v] for v in nb.tolist()), np.int64, len(nb)), sq, row))
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(self.n))[row] < self.k
        self.row, self.sq, self.nb = row[kept], sq[order][kept], nb[order][kept]
        last = np.zeros(self.n)
        np.maximum.at(last, self.row, self.sq)
        self.most = np.where(np.bincount(self.row, minlength=self.n) == self.k, last, np.inf)


def _slice(folder: str, group: int, kind: str):
    """(ids, cells, vectors) of a slice, from its file in the shared folder."""
    files, top = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
    names = [f.path for f in files.get_file_info(pafs.FileSelector(f"{top}/group={group}"))
             if f.base_name.startswith("part-")]
    t = pa.concat_tables([pq.ParquetFile(files.open_input_file(n)).read() for n in sorted(names)])
    ids = np.empty(len(t), object)
    ids[:] = t.column("id").to_pylist()
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(len(t), -1)
    return ids, t.column("cell").to_numpy(), x.astype(float)


def knn_exact(points: DataFrame, id_col: str, vector_col: str, k: int = 5, pivots: int = PIVOTS,
              slice_rows: int = 4096) -> DataFrame:
    """(src, nb, place, dist): the ``k`` nearest other rows of each row by
    Euclidean distance, nearest first from place 1, ties by smaller id.

    ``vector_col``: arrays of numbers of one length.  Ids are unique; rows with a
    null id or vector have no neighbours and are none.  Fewer than ``k`` other
    rows give as many places; an empty table gives an empty result.  ``points`` is
    computed four times."""
    spark = points.sparkSession
    element = points.schema[vector_col].dataType
    kind = "float" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "double"
    rows = (points.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
            .where("id IS NOT NULL AND x IS NOT NULL"))
    id_type = rows.schema["id"].dataType.simpleString()
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"src {id_type}, nb {id_type}, place int, dist double")
    chosen = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(min(pivots, max(1, round(n ** 0.5)))).collect()
    cells = _Cells(np.unique(np.array([r["x"] for r in chosen], float).reshape(len(chosen), -1), axis=0))
    sent, kind = spark.sparkContext.broadcast(cells), {"float": "<f4", "double": "<f8"}[kind]

    def homes(batches):
        for b in batches:
            if len(b):
                cell, d = sent.value.home(_matrix(b["x"]))
                yield pd.DataFrame({"cell": cell, "d": d})
    figures = rows.select("x").mapInPandas(homes, "cell long, d double").groupBy("cell").agg(
        F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("z"))
    for r in figures.collect():
        cells.size[r["cell"]], cells.inner[r["cell"]], cells.outer[r["cell"]] = r["n"], r["a"], r["z"]
    counted, bundle = spark.sparkContext.broadcast(cells), _bundles(cells, slice_rows)
    held = np.bincount(bundle, weights=cells.size).astype(np.int64)
    slices = np.maximum(-(-held // slice_rows), 1)
    first = np.cumsum(slices) - slices
    table = spark.createDataFrame([(i, int(first[b]), int(slices[b])) for i, b in enumerate(bundle)],
                                  "cell long, first int, slices int")

    def assign(batches):
        for b in batches:
            if len(b):
                x = _matrix(b["x"])
                yield pd.DataFrame({"id": b["id"], "cell": sent.value.home(x)[0], "x": [v.tobytes() for v in x.astype(kind)]})
    members = rows.mapInPandas(assign, f"id {id_type}, cell long, x binary").join(F.broadcast(table), "cell")
    members = members.select("id", "cell", "x", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices"))).alias("group"))
    folder = scratch_folder(spark, "slices")
    members.repartition("group").write.option("compression", "zstd").partitionBy("group").parquet(folder)
    sizes = {r["group"]: r["count"] for r in spark.read.parquet(folder).groupBy("group").count().collect()}
    probes = max(_PROBES, min(slice_rows, -(-n // (4 * spark.sparkContext.defaultParallelism))))
    tasks = [(int(g), at) for g, size in sorted(sizes.items()) for at in range(0, size, probes)]
    of_bundle = [np.flatnonzero(bundle == b) for b in range(len(held))]
    groups = [[g for g in range(f, f + s) if g in sizes] for f, s in zip(first.tolist(), slices.tolist())]

    def search(batches):
        for b in batches:
            for place in b["id"].tolist():
                group, at = tasks[place]
                ids, cell, x = _slice(folder, group, kind)
                mine = slice(at, at + probes)
                found = _Found(len(ids[mine]), k)
                every = np.arange(found.n)
                found.add(every, ids[mine], x[mine], ids, x)
                own, x = ids[mine], x[mine]
                low, bound = counted.value.bounds(x, cell[mine], k)
                low = np.where(np.isfinite(low), low, np.inf)
                low = np.stack([low[:, c].min(axis=1) for c in of_bundle], axis=1)
                near_first = np.minimum(low, 1e300 / len(low)).sum(axis=0).argsort()
                for there in near_first.tolist():
                    for other in groups[there]:
                        reach = _roomy(np.minimum(np.sqrt(found.most), bound))
                        near = np.flatnonzero((low[:, there] <= reach) & (low[:, there] < np.inf))
                        if other != group and len(near):
                            other_ids, _, y = _slice(folder, other, kind)
                            found.add(near, own[near], x[near], other_ids, y)
                yield pd.DataFrame({"src": own[found.row], "nb": found.nb, "sq": found.sq})
    found = spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(search, f"src {id_type}, nb {id_type}, sq double")
    w = Window.partitionBy("src").orderBy("sq", "nb")  # k rows, and as many for each other row of an id
    return (found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
            .select("src", "nb", "place", F.sqrt("sq").alias("dist")))
