"""Spelling variant grouping (13): PartEnum signatures over letter multisets.

1. Runs of letters become words (``word_counts``, pre-aggregated in the tasks)
   and a vocabulary with numbers of occurrences.
2. A word's letters are a binary vector with one dimension per (letter,
   how many of it came before).  A replaced letter changes two dimensions, an
   inserted or deleted one changes one, so near words have a Hamming distance of
   two at most.
3. *Partition and enumerate*: the dimensions are dealt to ``parts`` partitions
   of equal weight; a signature projects the vector on ``parts - 2`` of them, in
   every combination.  Near words share at least one signature.
4. Letters alone say nothing about their order, and anagrams are many.  One
   changed letter lies in one of ``pieces`` stretches of the word, so a
   signature is joined with the word's text outside each stretch in turn: near
   words still share a key, and keys are far more selective.  Both lengths that
   a pair can have are covered by a *role*: the word as the shorter one of its
   pair (or one of two equal lengths), or as the longer one.
5. Keys meet in an equi-join whose condition verifies the edit distance in
   full.  Keys held by more than ``crowd`` rows are cut again by shorter
   stretches inside the stretch before they are joined, which loses no pair.
6. A word's form is its most frequent near word, if frequent enough; roots
   follow forms by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import mix
from .storage import cut, text_column

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words a task counts before it hands them on.
HELD = 200_000
#: A letter's occurrences in a word have dimensions of their own up to here;
#: later ones share the last label, which changes no distance.
LABELS = 64
DISTANCE = 2
_SUB = 3


def typo(word: str, prefix: int, every: int) -> str:
    """``word``, without one code point if the crc32 of ``<id>:<word>`` is a
    multiple of ``every``; ``prefix`` is the crc32 of ``<id>:``."""
    h = zlib.crc32(word.encode(), prefix)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7,
                every: int = 31) -> DataFrame:
    """(word, n): occurrences of all words of at least ``least`` code points."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # after A-Z are lowered; greedy, so runs are maximal

    def count(batches):
        held: Counter[str] = Counter()
        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), text_column(b, "text")):
                lowered = text.as_buffer().to_pybytes().translate(_LOWER).decode() if text.as_buffer() else ""
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(runs.findall(lowered)).items():
                    word = typo(run, prefix, every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield from _counted(held)
                    held = Counter()
        yield from _counted(held)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter):
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                         ["word", "n"])


def dimensions(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(label, word) of every letter of the words: code point and how many of
    the same came before."""
    sizes = pc.utf8_length(words).to_numpy()
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, owner))
    letter, word = flat[order], owner[order]
    new = np.ones(len(letter), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    before = np.arange(len(letter)) - np.repeat(first, np.diff(np.append(first, len(letter))))
    return letter * LABELS + np.minimum(before, LABELS - 1), word


def deal(weights: dict[int, int], parts: int) -> dict[int, int]:
    """Partition of each dimension: the heaviest first, to the lightest one."""
    load, out = [0] * parts, {}
    for label, n in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        out[label] = min(range(parts), key=lambda p: (load[p], p))
        load[out[label]] += n
    return out


def _weights(words: DataFrame) -> dict[int, int]:
    """Words per dimension, over all words; there are at most LABELS rows for
    each letter of the alphabet."""
    def count(batches):
        for b in batches:
            label, n = np.unique(dimensions(b.column("word"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(n)], ["label", "n"])
    got = words.select("word").mapInArrow(count, "label long, n long").groupBy("label").agg(F.sum("n").alias("n"))
    return {r["label"]: r["n"] for r in got.collect()}


def signatures(words: DataFrame, parts: int = 3) -> DataFrame:
    """``words`` with ``sigs``: for every choice of two partitions, a hash of
    the vector on all others."""
    dealt = deal(_weights(words), parts)
    labels = np.array(sorted(dealt), np.int64)
    places = np.array([dealt[x] for x in labels.tolist()], np.int64)
    left_out = list(combinations(range(parts), DISTANCE))

    def run(batches):
        for b in batches:
            label, word = dimensions(b.column("word"))
            part = places[np.searchsorted(labels, label)]
            sums = np.zeros((parts, b.num_rows), np.uint64)
            np.add.at(sums, (part, word), mix(label.astype(np.uint64)))
            whole = sums.sum(axis=0)
            sigs = np.stack([mix(whole - sums[list(out)].sum(axis=0) + np.uint64(i)) for i, out in
                             enumerate(left_out)], axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(left_out), pa.int32()),
                                             pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "sigs"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{schema}, sigs array<long>")


def _without(word: Column, start: Column, end: Column, role: Column) -> Column:
    """The word's text outside a stretch; the longer word's stretch has one
    letter more."""
    return F.concat(F.substring(word, F.lit(1), start), F.substring(word, end + role + 1, F.length(word)))


def _keys(words: DataFrame, parts: int, pieces: int) -> DataFrame:
    """(key, word, n, role, start, end): one row per signature, stretch, role."""
    word, made = F.col("word"), []
    for role in (0, 1):
        size = F.length(word) - role
        for i in range(pieces):
            start, end = F.floor(size * i / pieces).cast("int"), F.floor(size * (i + 1) / pieces).cast("int")
            rest = F.xxhash64(size, F.lit(i), _without(word, start, end, F.lit(role)))
            made.append(F.struct(rest.alias("rest"), F.lit(role).alias("role"), start.alias("start"),
                                 end.alias("end")))
    rows = words.select("word", "n", "sigs", F.explode(F.array(*made)).alias("p"))
    rows = rows.select("word", "n", "p.*", F.posexplode("sigs").alias("k", "sig"))
    return rows.select(F.xxhash64("k", "sig", "rest").alias("key"), "word", "n", "role", "start", "end")


def _crowded(keys: DataFrame) -> DataFrame:
    """The same rows under keys of shorter stretches."""
    width = F.col("end") - F.col("start")
    rows = keys.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(_SUB - 1))))
    start = (F.col("start") + F.floor(width * F.col("j") / _SUB)).cast("int")
    end = (F.col("start") + F.floor(width * (F.col("j") + 1) / _SUB)).cast("int")
    rows = rows.withColumn("from", start).withColumn("to", end)
    rest = _without(F.col("word"), F.col("from"), F.col("to"), F.col("role"))
    return rows.select(F.xxhash64("key", "j", rest).alias("key"), "word", "n", "role")


def near_words(words: DataFrame, parts: int = 3, pieces: int = 3, crowd: int = 256) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of distinct words
    at an edit distance of exactly one.  ``words``: distinct (word, n)."""
    keys = _keys(signatures(words, parts), parts, pieces)
    hot = cut(keys.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowds")
    few = keys.join(hot, "key", "left_anti").select("key", "word", "n", "role")
    found = _verified(few)
    if hot.take(1):
        found = found.union(_verified(_crowded(keys.join(hot, "key", "left_semi"))))
    found = found.distinct()
    back = found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                        F.col("n").alias("near_n"))
    return found.union(back)


def _verified(keys: DataFrame) -> DataFrame:
    """Pairs under a key whose edit distance is one, the shorter word first.

    Spark sizes ``keys`` as the words' file, though it has a row per signature,
    stretch and role; the hint keeps it from broadcasting them."""
    a = keys.where("role = 0").select("key", "word", "n")
    b = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "role")
    pairs = a.join(b.hint("merge"), "key").where(((F.col("role") == 1) | (F.col("word") < F.col("near")))
                                   & (F.levenshtein("word", "near", 1) == 1))
    return pairs.select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): ``form`` followed to its last.  Each
    round doubles the steps made, so the rounds are the logarithm of the longest
    chain (n grows tenfold with each step).  The hint is for the size of the files,
    which hold a word in a few bytes: as a broadcast it takes many times that."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        at = cut(at.join(further.hint("merge"), at["root"] == further["via"], "left")
                 .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                 "roots")
        if not at.where("moved").take(1):
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7,
                      occurrences: int = 2, ratio: int = 10, every: int = 31, parts: int = 3,
                      pieces: int = 3, crowd: int = 256) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``,
    ``form_n``.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered,
    a code point left out where the crc32 of ``<id>:<run>`` is a multiple of
    ``every``, of at least ``least`` code points and ``occurrences`` occurrences.
    ``form`` is the near word (edit distance one) of largest n, ties to the
    smallest, if that n is at least ``ratio`` times the word's.

    Defined cases: null and empty texts have no words; a null id counts as an
    empty one; repeated rows count each; runs of any length are words; an empty
    table, or one without words, gives an empty result; other columns are
    ignored, whatever their names."""
    words = cut(word_counts(df, id_col, text_col, least, every).where(F.col("n") >= occurrences), "words")
    near = near_words(words, parts, pieces, crowd)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    taken = -F.col("b.m") >= F.col("n") * ratio
    out = cut(words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("b.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, -F.col("b.m")).alias("form_n")), "forms")
    last = roots(out.where(F.col("form").isNotNull()))
    return out.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                 "n_near", "form_n")
