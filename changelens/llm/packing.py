"""Packing (1): hierarchical multi-length packing.

Each task packs the documents of its partition in bounded blocks, so nothing
is shuffled and no group can be too large:

* *route*: full windows are cut off a long document; what is left goes to the
  smallest tier (512, 1024, 2048, 4096 tokens) that holds it;
* *pack*: a tier's windows are opened from its own documents, longest first;
* *fill*: the gap of a window is filled from the shorter tiers, best fit
  first, and closed exactly by cutting a document where none fits;
* *balance*: a block's windows are dealt to step groups, longest first to the
  emptiest group, so the groups hold the same number of tokens.

What does not fill a window of the shortest tier moves on to the next block;
a partition's last tokens form windows of falling powers of two.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import text_column, tidy
from .tokens import encoder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 16
BLOCK_TOKENS = 1 << 20


def route(length: int, tiers: tuple[int, ...]) -> int:
    """The smallest tier that holds ``length`` tokens (at most the largest)."""
    return next(i for i, t in enumerate(tiers) if length <= t)


def pack_block(docs: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool):
    """``docs``: (document, start, length) with length > 0.  Returns the filled
    windows, lists of such pieces, and the pieces left for the next block."""
    top, windows, by_tier = tiers[-1], [], [[] for _ in tiers]
    for doc, start, n in docs:
        while n >= top:
            windows.append([(doc, start, top)])
            start, n = start + top, n - top
        if n:
            by_tier[route(n, tiers)].append((n, doc, start))
    short: list[tuple[int, int, int]] = []  # sorted by length: what may fill gaps
    pools = [sorted(p) for p in by_tier]
    for t in range(len(tiers) - 1, 0, -1):
        short = sorted(x for p in pools[:t] for x in p)
        for n, doc, start in reversed(pools[t]):
            windows.append(_fill([(doc, start, n)], tiers[t] - n, short))
        pools = [[] for _ in range(t)]
        for x in short:
            pools[route(x[0], tiers)].append(x)
    rest = deque((doc, start, n) for n, doc, start in reversed(pools[0]))
    sizes, total = [], sum(x[2] for x in rest)
    sizes += [tiers[0]] * (total // tiers[0])
    if last:
        sizes += [1 << b for b in range(tiers[0].bit_length(), -1, -1) if total % tiers[0] >> b & 1]
    for size in sizes:
        window, room = [], size
        while room:
            doc, start, n = rest.popleft()
            take = min(n, room)
            window.append((doc, start, take))
            room -= take
            if n > take:
                rest.appendleft((doc, start + take, n - take))
        windows.append(window)
    open_windows = [w for w in windows if not _closed(w, tiers)]
    if not last:  # a window with a gap that nothing could fill waits for the next block
        rest += [p for w in open_windows for p in w]
        windows = [w for w in windows if _closed(w, tiers)]
    else:
        windows = [w for w in windows if _closed(w, tiers)] + _powers(open_windows)
    return windows, list(rest)


def _closed(window, tiers) -> bool:
    n = sum(p[2] for p in window)
    return n in tiers or n & (n - 1) == 0


def _powers(windows):
    """Cut unfilled windows into windows of powers of two."""
    out = []
    for pieces in windows:
        left = [list(p) for p in pieces]
        n = sum(p[2] for p in left)
        for b in range(n.bit_length(), -1, -1):
            if n >> b & 1:
                window, room = [], 1 << b
                while room:
                    take = min(left[0][2], room)
                    window.append((left[0][0], left[0][1], take))
                    left[0][1] += take
                    left[0][2] -= take
                    room -= take
                    if not left[0][2]:
                        left.pop(0)
                out.append(window)
    return out


def _fill(window, gap: int, short) -> list:
    """Fill ``gap`` from ``short``, best fit first; cut the next longer
    document where none fits."""
    while gap and short:
        at = bisect_right(short, (gap, float("inf"), 0)) - 1
        if at >= 0:
            n, doc, start = short.pop(at)
            window.append((doc, start, n))
            gap -= n
        else:
            n, doc, start = short.pop(0)
            window.append((doc, start, gap))
            insort(short, (n - gap, doc, start + gap))
            gap = 0
    return window


def balance(sizes: list[int], step_tokens: int) -> list[int]:
    """Step group of each window: longest first to the emptiest group."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int | None = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``tier`` (window size),
    ``step_group`` and, if asked for, the piece's ``ids``.

    Defined cases: null and empty texts are just the end id (no row if there
    is none); a null id is kept as null; repeated rows are packed each on
    their own; an empty table gives an empty result; other columns are
    ignored.  ``tiers`` are rising powers of two."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, tier long, step_group long" + (", ids array<long>" if with_ids else ""))

    def run(batches):
        encode = encoder(tokenizer, end_id)
        base = TaskContext.get().partitionId() << 36
        counters = [0, 0]  # sequences and step groups so far
        held: dict[int, tuple] = {}  # document number -> (id, ids, total)
        waiting: list[tuple[int, int, int]] = []
        number = size = 0
        id_arrow = None

        def flush(last: bool):
            nonlocal waiting, size
            windows, waiting = pack_block(waiting, tiers, last)
            lengths = [sum(p[2] for p in w) for w in windows]
            groups = balance(lengths, step_tokens)
            cols: list[list] = [[] for _ in range(10)]
            for w, n, g in zip(windows, lengths, groups):
                offset, seq = 0, base | counters[0]
                counters[0] += 1
                for doc, start, length in w:
                    key, ids, first, total = held[doc]
                    part = ids[start - first:start - first + length]
                    for c, v in zip(cols, (key, start, length, zlib.crc32(part.tobytes()), total, seq, offset,
                                           1 << max(0, n - 1).bit_length(), base | counters[1] + g,
                                           part if with_ids else None)):
                        c.append(v)
                    offset += length
            counters[1] += max(groups, default=-1) + 1
            keep = {}
            for doc, start, length in waiting:  # of a document, only what still waits
                key, ids, first, total = held[doc]
                low = min(start, keep[doc][2]) if doc in keep else start
                keep[doc] = (key, ids[low - first:].copy() if doc not in keep or low < keep[doc][2]
                             else keep[doc][1], low, total)
            held.clear()
            held.update(keep)
            size = sum(p[2] for p in waiting)
            if cols[0]:
                arrays = [pa.array(cols[0], id_arrow)] + [pa.array(c, pa.int64()) for c in cols[1:9]]
                if with_ids:
                    arrays.append(pa.array(cols[9], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names)

        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        for b in batches:
            id_arrow = b.column("id").type
            keys = b.column("id").to_pylist()
            for at, ids, lengths in encode.encode(text_column(b, "text"), 2 << 20):
                start = 0
                for i, n in enumerate(lengths.tolist()):
                    if n:
                        held[number] = (keys[at + i], ids[start:start + n].astype("<u4"), 0, n)
                        waiting.append((number, 0, n))
                        number, size, start = number + 1, size + n, start + n
                    if size >= BLOCK_TOKENS:
                        yield from flush(False)
        if waiting:
            yield from flush(True)

    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
