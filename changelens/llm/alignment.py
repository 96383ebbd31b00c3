"""Cross-tokenizer alignment (12): lockstep vectorised merging.

1. Each task encodes slices of texts with both tokenizers; a token is known by
   the byte offset where it ends.
2. *Lockstep*: one state vector holds an A and a B pointer for every lane (a
   document; a long one is cut into lanes at ends that both sides have).  Each
   step compares the ends under all pointers, emits the overlapping pairs as links
   and the equal ends as cuts, advances the pointer that is behind (both at a
   cut), and compacts lanes that are done.
3. Cuts delimit groups.  Where a group has several tokens on both sides, its
   overlapping pairs are completed to all pairs.
4. The links of a block of documents are kept as numbers into the block's own
   list of id pairs.  Only these lists (distinct pairs and in how many of the
   block's documents they are) are summed over the corpus and joined back, so
   what is shuffled is far less than the links.
5. Blocks meet the counts of their list, and every document sums them up.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, text_column
from .tokens import _WHOLE, gather, slices

#: Bytes of text that are encoded and merged at once, and that share a list.
SLICE, BLOCK = 2 << 20, 8 << 20
#: Tokens of a lane, about.
LANE = 512
#: Links of groups with several tokens on both sides that are made at once.
_LINKS = 1 << 21
#: Words and ids that a worker remembers before it starts anew (about 150 MB).
CACHE_WORDS, CACHE_IDS = 700_000, 8_000_000
_SPACE_MARK = "▁"
_ODD = _WHOLE + "|" + _SPACE_MARK
_workers: dict[tuple, "Pair"] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable
    Latin-1 characters stand for themselves, the others for 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ragged:
    """Rows of different length in one array."""

    def __init__(self, rows: list, dtype):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.asarray(r, dtype) for r in rows]) if rows else np.zeros(0, dtype)

    def extend(self, more: list[tuple[np.ndarray, np.ndarray]]):
        """Add rows, given as (all values, sizes)."""
        self.flat = np.concatenate([self.flat, *[x[0] for x in more]])
        self.sizes = np.concatenate([self.sizes, *[x[1] for x in more]])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, at: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[at], self.sizes[at])


class Side:
    """A vocabulary: the bytes of each id, and its decimal digits for texts."""

    def __init__(self, entries: list[bytes]):
        self.bytes = Ragged([np.frombuffer(e, np.uint8) for e in entries], np.uint8)
        self.digits = Ragged([np.frombuffer(f"{i},".encode(), np.uint8) for i in range(len(entries))], np.uint8)
        self.size = len(entries)


class Pair:
    """Both tokenizers, with the words that this worker has met before.

    Neither lets a token run past a word into the white space that follows, so
    texts with plain white space are cut before each space and line feed, and
    only new words are encoded.  All other texts are encoded whole."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.words_a = Tokenizer.from_file(path_a), Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        special = {t.content: i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.between, self.between_id = min(special.items(), key=lambda x: x[1])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.side_a = Side([bytes(alphabet[c] for c in entries[i]) if i in entries and i not in special.values()
                            else entries.get(i, "").encode() for i in range(max(entries) + 1)])
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = Side([bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace(_SPACE_MARK, " ").encode()
                            for i, n in enumerate(names)])
        self.mark = self.b.piece_to_id(_SPACE_MARK)
        # a piece that runs on past white space would make words depend on each other
        self.cached = not any(_SPACE_MARK in n.lstrip(_SPACE_MARK) or "\n" in n for n in names)
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.ids = [Ragged([], np.int32), Ragged([], np.int32)]

    def _learn(self, words: list[str]):
        found: list[list] = [[], []]
        for at in range(0, len(words), 2000):
            part = words[at:at + 2000]
            ids = np.array(self.words_a.encode(self.between.join(part), add_special_tokens=False).ids, np.int32)
            between = ids == self.between_id
            bounds = np.concatenate(([-1], np.flatnonzero(between), [len(ids)]))
            found[0].append((ids[~between], np.diff(bounds) - 1))
            # a leading space is what the model itself puts before a text
            made = self.b.encode([w[1:] if w[0] == " " else w for w in part], num_threads=1)
            made = [x if w[0] == " " else x[1:] for w, x in zip(part, made)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            found[1].append((np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum())), sizes))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        for held, new in zip(self.ids, found):
            held.extend(new)

    def _by_words(self, texts: pa.LargeStringArray):
        spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), pc.replace_substring(texts, "\n", " \n"),
                                             pa.scalar(" ", texts.type))  # " " before the text, as before any word
        parts = pc.split_pattern(spaced, " ")
        words = pc.list_flatten(parts)
        owner = pc.list_parent_indices(parts).to_numpy()
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]  # the empty word before a text's own space
        words, owner = words.filter(pa.array(~first)), owner[~first]
        coded = words.dictionary_encode()
        distinct = [w if w[:1] == "\n" else " " + w for w in coded.dictionary.to_pylist()]
        if len(self.known) + len(distinct) > CACHE_WORDS or sum(len(x.flat) for x in self.ids) > CACHE_IDS:
            self._forget()
        self._learn([w for w in distinct if w not in self.known])
        of = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[
            coded.indices.to_numpy(zero_copy_only=False)]
        return [(x.take(of).astype(np.int64), np.bincount(owner, x.sizes[of], len(texts)).astype(np.int64)) for x in self.ids]

    def encode(self, texts: pa.LargeStringArray) -> list[list[np.ndarray]]:
        """For A and B, the ids of each text; none for empty texts."""
        sizes = pc.binary_length(texts).to_numpy()
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.cached \
            else np.ones(len(texts), bool)
        out: list[list] = [[np.zeros(0, np.int64)] * len(texts) for _ in range(2)]
        plain = np.flatnonzero(~odd & (sizes > 0))
        if len(plain):
            for side, (ids, counts) in zip(out, self._by_words(texts.take(pa.array(plain)))):
                for i, x in zip(plain.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
                    side[i] = x
        for i in np.flatnonzero(odd & (sizes > 0)).tolist():
            text = texts[i].as_py()
            out[0][i] = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
            out[1][i] = np.array(self.b.encode(text, num_threads=1), np.int64)
        return out


def pair_of(path_a: str, path_b: str) -> Pair:
    """This worker's tokenizers; they stay between tasks."""
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Pair(path_a, path_b)
    return _workers[path_a, path_b]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, lane: int = LANE):
    """(first A, end A, first B, end B) of each lane: documents, cut after about
    every ``lane`` A tokens where an A and a B token end at the same byte.

    ``last_a``: the last A token of each document."""
    every = np.arange(lane - 1, len(ends_a), lane)
    ask = np.unique(np.concatenate((every, last_a)))
    at = np.searchsorted(ends_b, ends_a[ask])
    common = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[ask]
    stop_a, stop_b = ask[common] + 1, at[common] + 1
    return (np.concatenate(([0], stop_a[:-1])), stop_a, np.concatenate(([0], stop_b[:-1])), stop_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, stop_a: np.ndarray, b: np.ndarray):
    """Merge all lanes at once.  ``ends``: rising byte offsets over all
    documents; ``a``, ``b``: first tokens of the lanes.  Returns links (A token,
    B token), overlapping pairs in no order, and whether a cut follows."""
    a, b, out = a.copy(), b.copy(), []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        out.append((a.copy(), b.copy(), end_a == end_b))
        a += end_a <= end_b
        b += end_b <= end_a
        on = a < stop_a
        if not on.all():
            a, b, stop_a = a[on], b[on], stop_a[on]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def groups(a: np.ndarray, b: np.ndarray, cuts: np.ndarray):
    """Tokens of each group, from the links and cuts: sizes on both sides."""
    last_a = np.sort(a[cuts])
    last_b = np.sort(b[cuts])
    return np.diff(np.concatenate(([-1], last_a))), np.diff(np.concatenate(([-1], last_b)))


def _products(ids_a, ids_b, first_a, n_a, first_b, n_b):
    """All pairs within each group, a bounded number at a time: yields (group,
    A id, B id, how often)."""
    for g, z in slices(n_a * n_b, _LINKS):
        if z - g == 1 and n_a[g] * n_b[g] > _LINKS:  # a very long group: distinct ids on both sides
            left, times_a = np.unique(ids_a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
            right, times_b = np.unique(ids_b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
            step = max(1, _LINKS // len(right))
            for i in range(0, len(left), step):
                x, t = left[i:i + step], times_a[i:i + step]
                yield (np.full(len(x) * len(right), g), np.repeat(x, len(right)), np.tile(right, len(x)),
                       np.repeat(t, len(right)) * np.tile(times_b, len(x)))
            continue
        n = n_a[g:z] * n_b[g:z]
        of = np.repeat(np.arange(g, z), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield of, ids_a[first_a[of] + place // n_b[of]], ids_b[first_b[of] + place % n_b[of]], np.ones(len(of), np.int64)


def _texts(side_a: Side, side_b: Side, ids_a, ids_b, n_a, n_b, of_group) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all documents as ``a1,a2|b1;`` in one array of bytes, and
    the bytes of each document (``of_group``: the document of each group)."""
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + (before_a + n_a)[group_b]
    starts, sizes = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.int64)
    flat = np.concatenate((side_a.digits.flat, side_b.digits.flat))
    starts[place_a], sizes[place_a] = side_a.digits.starts[ids_a], side_a.digits.sizes[ids_a]
    starts[place_b] = side_b.digits.starts[ids_b] + len(side_a.digits.flat)
    sizes[place_b] = side_b.digits.sizes[ids_b]
    out = gather(flat, starts, sizes)
    ends = np.cumsum(sizes) - 1  # the mark after each id
    out[ends[place_a[np.cumsum(n_a) - 1]]] = ord("|")
    out[ends[place_b[np.cumsum(n_b) - 1]]] = ord(";")
    owner = np.empty(len(sizes), np.int64)
    owner[place_a], owner[place_b] = of_group[group_a], of_group[group_b]
    return out, np.bincount(owner, sizes, of_group[-1] + 1 if len(of_group) else 0).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first
    byte tells how many."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def align_texts(pair: Pair, texts: pa.LargeStringArray):
    """Align a slice of texts.  Returns per text n_a, n_b, n_groups, n_links,
    the hash of its groups, and its distinct id pairs: (text, A id, B id, how
    often), sorted by text."""
    n = len(texts)
    encoded = pair.encode(texts)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    plain = [b" " + t.as_buffer().to_pybytes() if t.as_buffer() else b" " for t in texts]
    good = size > 0
    for side, ids in zip((pair.side_a, pair.side_b), encoded):
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if n else np.zeros(0, np.int64)
        joined = side.bytes.take(flat)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(n), counts), side.bytes.sizes[flat],
                                                            n).astype(np.int64))))
        for i in np.flatnonzero(good).tolist():
            good[i] = joined[bounds[i]:bounds[i + 1]].tobytes() == plain[i]
    del plain
    live = np.flatnonzero(good)
    table = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    hashes = [""] * n
    nothing = np.zeros(0, np.int64)
    if not len(live):
        return table, hashes, (nothing, nothing, nothing, nothing)
    (ids_a, n_a), (ids_b, n_b) = [(np.concatenate([x[i] for i in live]), np.array([len(x[i]) for i in live], np.int64))
                                  for x in encoded]
    del encoded
    ends_a, ends_b = np.cumsum(pair.side_a.bytes.sizes[ids_a]), np.cumsum(pair.side_b.bytes.sizes[ids_b])
    first_a, stop_a, first_b, _ = lanes(ends_a, ends_b, np.cumsum(n_a) - 1)
    link_a, link_b, cuts = lockstep(ends_a, ends_b, first_a, stop_a, first_b)
    in_a, in_b = groups(link_a, link_b, cuts)
    start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    doc_of_a = np.repeat(np.arange(len(live)), n_a)
    doc_of_group = doc_of_a[start_a]
    table["n_a"][live], table["n_b"][live] = n_a, n_b
    table["n_groups"][live] = np.bincount(doc_of_group, minlength=len(live))
    table["n_links"][live] = np.rint(np.bincount(doc_of_group, in_a * in_b, len(live))).astype(np.int64)
    written, sizes = _texts(pair.side_a, pair.side_b, ids_a, ids_b, in_a, in_b, doc_of_group)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for k, i in enumerate(live.tolist()):
        hashes[i] = hashlib.sha256(written[bounds[k]:bounds[k + 1] - 1]).hexdigest()
    del written
    several = (in_a > 1) & (in_b > 1)  # overlapping pairs are not all pairs there
    simple = ~several[np.repeat(np.arange(len(in_a)), in_a)[link_a]]
    wide = pair.side_b.size

    def packed(doc, a, b):
        return (doc * pair.side_a.size + a) * wide + b
    keys, times = np.unique(packed(doc_of_a[link_a[simple]], ids_a[link_a[simple]], ids_b[link_b[simple]]),
                            return_counts=True)
    of = np.flatnonzero(several)
    for g, a, b, t in _products(ids_a, ids_b, start_a[of], in_a[of], start_b[of], in_b[of]):
        more, place = np.unique(packed(doc_of_group[of[g]], a, b), return_inverse=True)
        keys, place = np.unique(np.concatenate((keys, more)), return_inverse=True), np.bincount(
            place, t, len(more)).astype(np.int64)
        (keys, inverse), both = keys, np.concatenate((times, place))
        times = np.bincount(inverse, both, len(keys)).astype(np.int64)
    return table, hashes, (live[keys // wide // pair.side_a.size], keys // wide % pair.side_a.size, keys % wide, times)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(tokenizer_a: str, tokenizer_b: str, id_type: str):
    """Documents and the lists of their blocks, as rows of one table: a list
    row has ``pairs`` (A id and B id in one number) and ``docs``, others have
    ``at`` and ``times``, numbers into the list and how often."""
    schema = (f"block long, id {id_type}, {', '.join(f'{k} long' for k in _NUMBERS)}, groups_sha256 string, "
              "at binary, times binary, pairs array<long>, docs array<long>")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        pair, base, number = pair_of(tokenizer_a, tokenizer_b), TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, number
            key = np.concatenate([h[2] for h in held])
            pairs, at, docs = np.unique(key, return_inverse=True, return_counts=True)
            begin = 0
            for ids, (table, hashes), keys, counts, times in held:
                mine = at[begin:begin + len(keys)]
                begin += len(keys)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                cells = [(_small(np.diff(mine[x:y], prepend=0)), _small(times[x:y]))
                         for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                k = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, base | number)), ids, *[pa.array(table[c]) for c in _NUMBERS],
                     pa.array(hashes, pa.string()), pa.array([c[0] for c in cells], pa.binary()),
                     pa.array([c[1] for c in cells], pa.binary()), pa.nulls(k, pa.list_(pa.int64())),
                     pa.nulls(k, pa.list_(pa.int64()))], names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base | number]), pa.nulls(1, held[0][0].type), *[pa.nulls(1, pa.int64())] * 4,
                 pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64()))], names)
            held, size, number = [], 0, number + 1

        for b in batches:
            column = text_column(b, "text")
            lengths = pc.binary_length(column).to_numpy()
            for x, y in slices(np.maximum(lengths, 64), SLICE):
                table, hashes, (doc, a, bb, times) = align_texts(pair, column.slice(x, y - x))
                # pairs rise within a document, so the numbers into the list do too
                held.append((b.column("id").slice(x, y - x), (table, hashes), a << 32 | bb,
                             np.bincount(doc, minlength=y - x), times))
                size += int(np.maximum(lengths[x:y], 64).sum())
                if size >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()
    return run, schema


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n, best): documents corpus-wide that hold an id pair linked, and
    whether no other pair of its A id has more."""
    totals = cut(lists.groupBy("pair").agg(F.sum("docs").alias("n")), "pairs")
    most = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return (totals.join(most, F.shiftright(totals["pair"], 32) == most["a"])
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with the counts of its list."""
    place = right.column("place").to_numpy()
    counts, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    counts[place] = right.column("n").to_numpy()
    best[place] = right.column("best").to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for at, times in zip(left.column("at").to_pylist(), left.column("times").to_pylist()):
        at, times = np.cumsum(_large(at)), _large(times)
        n_best.append(int(times[best[at]].sum()))
        total.append(int((times * counts[at]).sum()))
    kept = left.select(["id", *_NUMBERS])
    for name, values in (("n_best", n_best), ("count_sum", total)):
        kept = kept.append_column(name, pa.array(values, pa.int64()))
    return kept.append_column("groups_sha256", left.column("groups_sha256"))


def align_corpus(df: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_a``, ``n_b`` (tokens),
    ``n_groups``, ``n_links`` (A-B pairs that share a group), ``n_best`` (links
    whose count is their A id's highest, ties included), ``count_sum`` (of all
    links) and ``groups_sha256``.  A pair's count: documents that hold it linked.

    Defined cases: null and empty texts, and texts that a tokenizer does not
    give back byte for byte after the space put before them, have no tokens:
    zeros and an empty ``groups_sha256``.  Strings of special tokens are plain
    text.  Null ids are kept as null; repeated rows count each as a document;
    a long text is cut into lanes, never shortened; an empty table gives an empty
    result; other columns are ignored, whatever their names."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run, schema = _blocks(tokenizer_a, tokenizer_b, rows.schema["id"].dataType.simpleString())
    blocks = cut(rows.mapInArrow(run, schema), "blocks")
    lists = (blocks.where(F.col("pairs").isNotNull())
             .select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p"))
             .select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs")))
    counted = lists.select("block", "place", "pair").join(pair_counts(lists), "pair").select(
        F.col("block").alias("of"), "place", "n", "best")
    documents = blocks.where(F.col("pairs").isNull()).drop("pairs", "docs")
    out_schema = (f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in _NUMBERS)}, "
                  "n_best long, count_sum long, groups_sha256 string")
    out = documents.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_summed, out_schema)
    return out.withColumnRenamed("id", id_col)


def links(df: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(``id_col``, ``a``, ``b``, ``times``): the distinct linked id pairs of
    each document and how often each is linked; none for texts without tokens."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        pair = pair_of(tokenizer_a, tokenizer_b)
        for batch in batches:
            column = text_column(batch, "text")
            for x, y in slices(np.maximum(pc.binary_length(column).to_numpy(), 64), SLICE):
                doc, a, b, times = align_texts(pair, column.slice(x, y - x))[2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(doc + x)), pa.array(a), pa.array(b), pa.array(times)],
                    ["id", "a", "b", "times"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a long, b long, times long"
                           ).withColumnRenamed("id", id_col)
