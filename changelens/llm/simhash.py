"""SimHash near-dedup (6): a Gray-order hierarchical index.

1. One 64-bit fingerprint per document from its word shingles.
2. Equal fingerprints collapse to one row (pre-aggregated, so a group of
   copies never meets in one task).
3. Fingerprints are sorted by Gray rank: fingerprints next to each other
   share leading bits, so quantiles of the rank give a balanced trie whose
   nodes are masked bit patterns.  The trie is small (at most ``53 * 4 P``
   nodes for P shuffle partitions) and is sent to the executors.
4. Every fingerprint walks the trie, adding up differing bits per node; a
   node past the allowed distance is pruned with all that lies below.  It is
   dealt to the leaves that survive.
5. A leaf holds its members in Gray order under further 8-bit pattern
   levels and prunes the same way; found links are reduced to a spanning
   forest before they leave the task.
6. Components over fingerprints, joined back to the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut, partitions, text_column, tidy

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAVES_PER_PARTITION = 4
_PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Majority vote per bit over the XXH64 of all ``size``-word shingles."""
    words = text.translate(_LOWER).split()  # ASCII white space, as bytes.split() has it
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())),
                         np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 3, seed: int = 42) -> DataFrame:
    """(id, h, fp): a hash of the text, and the fingerprint's bits as a signed
    64-bit integer."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.as_buffer() else b"", size, seed)
                   for t in text_column(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("h"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "h", "fp"])
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, h long, fp long")


def _gray_rank(fp):
    """Rank of a bit pattern in Gray-code order (prefix exclusive-or)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _gray_rank_np(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Trie:
    """Nodes are (pattern, depth); the patterns are leading bits of codes."""

    def __init__(self, ranks: list[int]):
        """ranks: sorted quantiles of the top 53 bits of the Gray rank."""
        self.child = []  # (0-child, 1-child) or (-1, leaf number)
        self.leaves = 0
        codes = [r ^ (r >> 1) for r in ranks]  # Gray code of a rank: leading bits correspond

        def grow(inside, depth):
            at = len(self.child)
            self.child.append(None)
            if len(inside) <= 1 or depth == 53:
                self.child[at] = (-1, self.leaves)
                self.leaves += 1
            else:
                bit = 52 - depth
                self.child[at] = tuple(grow([c for c in inside if c >> bit & 1 == side], depth + 1)
                                       for side in (0, 1))
            return at
        grow(sorted(set(codes)), 0)
        self.child = np.array(self.child, np.int64)

    def walk(self, codes: np.ndarray, budget: int):
        """(index of the code, leaf, differing bits) for all leaves in reach."""
        q, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        diff, depth, out = np.zeros(len(codes), np.int8), 0, []
        while len(q):
            at_leaf = self.child[node, 0] < 0
            out.append((q[at_leaf], self.child[node[at_leaf], 1], diff[at_leaf]))
            q, node, diff = q[~at_leaf], node[~at_leaf], diff[~at_leaf]
            bit = (codes[q] >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64) if depth < 64 else q[:0]
            other = diff < budget
            q, node, diff = (np.concatenate((q, q[other])),
                             np.concatenate((self.child[node, bit], self.child[node[other], 1 - bit[other]])),
                             np.concatenate((diff, diff[other] + 1)))
            depth += 1
        return [np.concatenate(x) for x in zip(*out)]


def search(members: np.ndarray, probes: np.ndarray, budget: int):
    """Yield (member index, probe index) arrays of pairs within ``budget``
    bits.  ``members`` are distinct and sorted by Gray rank; they are grouped
    under ever longer leading patterns, 8 bits a level."""
    if not len(members):  # a leaf that only probes reach
        return
    levels, lows = [], np.zeros(1, np.int64)
    for depth in range(8, 65, 8):
        mask = np.uint64((1 << 64) - (1 << (64 - depth)))
        masked = members & mask
        starts = np.concatenate(([0], np.flatnonzero(masked[1:] != masked[:-1]) + 1)).astype(np.int64)
        first = np.searchsorted(starts, lows)  # children of the level above: starts[first[i]:first[i + 1]]
        levels.append((mask, starts, np.append(first, len(starts))))
        lows = starts
    step = 1 << 14
    for at in range(0, len(probes), step):
        q = np.arange(at, min(at + step, len(probes)))
        yield from _descend(members, probes, budget, levels, 0, q, np.zeros(len(q), np.int64))


def _descend(members, probes, budget, levels, level, q, node):
    if level == len(levels):
        yield levels[-1][1][node], q
        return
    mask, starts, first = levels[level]
    width = first[node + 1] - first[node]
    if len(q) > 1 and width.sum() > _PAIRS_AT_ONCE:
        half = len(q) // 2
        yield from _descend(members, probes, budget, levels, level, q[:half], node[:half])
        yield from _descend(members, probes, budget, levels, level, q[half:], node[half:])
        return
    nq = np.repeat(q, width)
    offset = np.arange(len(nq)) - np.repeat(np.cumsum(width) - width, width)
    child = np.repeat(first[node], width) + offset
    near = np.bitwise_count((probes[nq] ^ members[starts[child]]) & mask) <= budget
    yield from _descend(members, probes, budget, levels, level + 1, nq[near], child[near])


def forest(n: int, pairs) -> np.ndarray:
    """Smallest index reachable for each of ``n`` items, over batches of pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _leaf_links(budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pdf["fp"].to_numpy().view(np.uint64)
        own = pdf["own"].to_numpy()
        members = codes[own]
        members = members[np.argsort(_gray_rank_np(members), kind="stable")]
        everyone = np.concatenate((members, codes[~own]))
        label = forest(len(everyone), search(members, everyone, budget))
        signed, moved = everyone.view(np.int64), np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": signed[moved], "b": signed[label[moved]]})
    return run


def fingerprint_links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): a spanning set of links between distinct fingerprints ``fp``
    that differ in at most ``budget`` bits."""
    spark = distinct.sparkSession
    n_parts = partitions(spark)
    ask = [i / (LEAVES_PER_PARTITION * n_parts) for i in range(1, LEAVES_PER_PARTITION * n_parts)]
    rank = F.shiftrightunsigned(_gray_rank(F.col("fp")), 11).cast("double")
    quantiles = distinct.agg(F.percentile_approx(rank, ask, 20 * len(ask)).alias("q")).first()["q"]
    trie = Trie([int(x) for x in quantiles or []])
    sent = spark.sparkContext.broadcast(trie)

    def deal(batches):
        t = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1 << 13):
                signed = b.column("fp").slice(at, 1 << 13).to_numpy()
                codes = signed.view(np.uint64)
                home = np.zeros(len(codes), np.int64)
                q0, leaf0, _ = t.walk(codes, 0)
                home[q0] = leaf0
                q, leaf, _ = t.walk(codes, budget)
                later = leaf >= home[q]
                q, leaf = q[later], leaf[later]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(signed[q]), pa.array(leaf == home[q])], ["leaf", "fp", "own"])
    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long, own boolean")
    return dealt.groupBy("leaf").applyInPandas(_leaf_links(budget), "a long, b long")


def _grouped(df: DataFrame, id_col: str, text_col: str, size: int, seed: int, budget: int):
    """(id, h, fp) of all rows, and per fingerprint its component's smallest id
    and ``top``: (id, h) of the row that stands for the component, null ids last."""
    fps = cut(fingerprints(df, id_col, text_col, size, seed), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("low"), first.alias("top")), "distinct")
    roots = components(fingerprint_links(distinct, budget), "a", "b")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "low", "top", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min("top").alias("top"))
    return fps, rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id", "top")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links of at most ``budget``
    differing bits).

    Defined cases: null and empty texts have fingerprint zero and link like
    any other; rows with a null id keep their fingerprint and get the component
    of their fingerprint's other ids (null if there are none); repeated rows
    each get a row; an empty table gives an empty result."""
    fps, of_fp = _grouped(df, id_col, text_col, size, seed, budget)
    return fps.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42,
               budget: int = 2) -> DataFrame:
    """Of each component the row with the smallest id, all columns.

    Defined cases: rows are told apart by id and text, so a repeated id with
    another text is a row of its own; of several texts of the smallest id in a
    component one stays (the smallest hash); fully repeated rows stay or go
    together (exact dedup tells those); rows with a null id have no place in a
    component and stay; null and empty texts are one component; an empty table
    gives an empty result."""
    fps, of_fp = _grouped(df, id_col, text_col, size, seed, budget)
    stays = F.col("id").eqNullSafe(F.col("top.id")) & F.col("h").eqNullSafe(F.col("top.h"))
    dropped = fps.join(of_fp, "fp").where(F.col("id").isNotNull() & ~stays).select(
        F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__h"))
    return df.join(dropped, same, "left_anti")
