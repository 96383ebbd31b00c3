"""Mixing sources to target weights (10): iterative proportional fitting.

Token weights of (source, language, topic) cells are raked to target shares
of each of the three; a cell's weight, scaled to the token budget and at most
one, is the probability with which its documents are sampled.  Draws hash the
document id, so they are the same in every run and on every executor.

No class is merged with another.  Up to ``DRIVER_CELLS`` cells are raked in the
driver; more are raked as a table, by grouped sums that are joined back.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import TRIGRAMS, parts, raw, trigrams, words
from .storage import cut, text_column, tidy

AXES = ("source", "lang", "topic")
_NULL = "\x00null"
#: Cells (some 60 bytes each) that may pass through the driver.
DRIVER_CELLS = 200_000
#: Rows of counts that a round of k-means holds at once.
_ROWS = 2048
_log = logging.getLogger(__name__)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(texts) -> np.ndarray:
    return _unit(np.log1p(trigrams(*raw(texts)))).astype(np.float32)


def _packed(counts: np.ndarray) -> list[bytes]:
    """Each row of counts in as few bytes a count as its largest needs."""
    top = counts.max(axis=1, initial=0)
    return [x.astype("<u1" if m < 1 << 8 else "<u2" if m < 1 << 16 else "<u4").tobytes()
            for x, m in zip(counts, top.tolist())]


def _unpacked(column: pa.Array):
    """Unit vectors of rows of packed counts, a bounded number at a time."""
    column = column.cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy()
    for width in (1, 2, 4):
        rows = np.flatnonzero(sizes == width * TRIGRAMS)
        for at in range(0, len(rows), _ROWS):
            part = column.take(pa.array(rows[at:at + _ROWS]))
            counts = np.frombuffer(part.buffers()[2], f"<u{width}", len(part) * TRIGRAMS).reshape(-1, TRIGRAMS)
            x = _LOGS[counts] if width == 1 else np.log1p(counts.astype(np.float32))
            yield x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


_LOGS = np.log1p(np.arange(256)).astype(np.float32)


def fit_topics(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", topics: int = 8,
               sample_rows: int = 2048, rounds: int = 15) -> np.ndarray:
    """Topic centres: spherical k-means over the hashed trigrams of all
    documents, which are counted once and kept as a table of counts.  The first
    centres are fitted to the ``sample_rows`` documents with the smallest hash of
    id and text; then come up to ``rounds`` rounds over all documents, each a sum
    and a count per centre, until nothing changes; what the last one moved is
    logged.  Sums are of whole numbers, so they do not depend on the partitions."""
    def featurise(batches):
        for b in batches:
            texts = text_column(b, "text")
            for a, z in parts(texts):
                counts = trigrams(*raw(texts.slice(a, z - a)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("h").slice(a, z - a), b.column("t").slice(a, z - a),
                     pa.array(_packed(counts), pa.binary())], ["h", "t", "x"])
    keyed = df.select(F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    vectors = cut(keyed.mapInArrow(tidy(featurise), "h long, t long, x binary"), "vectors")
    ids = vectors.select("h", "t").orderBy("h", "t").limit(sample_rows).distinct()
    got = vectors.join(F.broadcast(ids), ["h", "t"], "left_semi").dropDuplicates(["h", "t"]).orderBy("h", "t").collect()
    if not got:
        return np.zeros((1, TRIGRAMS), np.float32)
    x = np.concatenate(list(_unpacked(pa.array([bytes(r["x"]) for r in got], pa.binary()))))
    centres = [x[0]]
    while len(centres) < min(topics, len(x)):  # the farthest document starts the next topic
        centres.append(x[(x @ np.stack(centres).T).max(axis=1).argmin()])
    centres = np.stack(centres)
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[near == i].sum(axis=0) if (near == i).any() else centres[i]
                                  for i in range(len(centres))]))
    centres, moved = centres.astype(np.float32), 0.0
    for _ in range(rounds):
        before, centres = centres, _moved(vectors, centres)
        moved = float(np.abs(centres - before).max())
        if moved < 1e-6:
            break
    _log.info("topic centres moved by %.2g in the last round", moved)
    return centres


def _moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after a round over all of ``vectors``."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def sums(batches):
        centres = sent.value
        total = np.zeros(centres.shape, np.int64)
        for b in batches:
            for x in _unpacked(b.column("x")):
                near = (x @ centres.T).argmax(axis=1)
                member = (near == np.arange(len(centres))[:, None]).astype(np.float64)
                total += (member @ np.rint(x * np.float32(1 << 24)).astype(np.float64)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])
    got = vectors.select("x").mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(centres.size)
    for r in got:
        total[r["at"]] = r["n"]
    total = total.reshape(centres.shape)
    return np.where(total.any(axis=1)[:, None], _unit(total), centres).astype(np.float32)


def annotate(df: DataFrame, centres: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``__topic`` (nearest centre) and ``__tokens`` (white-space
    separated words, at least 1, so a document without words still weighs)."""
    def run(batches):
        for b in batches:
            texts = text_column(b, text_col)
            topic, tokens = [], []
            for a, z in parts(texts):
                data, bounds = raw(texts.slice(a, z - a))
                near = _unit(np.log1p(trigrams(data, bounds))).astype(np.float32) @ centres.T
                topic.append(near.argmax(axis=1))
                tokens.append(np.maximum(1, np.bincount(words(data, bounds)[2], minlength=z - a)))
            yield pa.RecordBatch.from_arrays(
                b.columns + [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64())
                             for x in (topic, tokens)], b.schema.names + ["__topic", "__tokens"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(tidy(run), schema + ", __topic long, __tokens long")


def rake(tokens: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = 500,
         tolerance: float = 1e-9) -> np.ndarray:
    """Probability per cell (at most 1) of a full table of ``tokens``, one axis
    per margin; see ``rake_cells``."""
    codes = [x.ravel() for x in np.indices(tokens.shape)]
    return rake_cells(codes, tokens.ravel(), targets, budget, rounds, tolerance).reshape(tokens.shape)


def rake_cells(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], budget: float,
               rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Probability per cell (at most 1) for which the expected tokens of every
    axis class come to its target share of ``budget`` times all tokens, as near
    as the bound of 1 allows.  ``codes``: each cell's class on every axis;
    ``targets``: shares per axis, summing to 1 over the classes with tokens."""
    p, total = np.full(len(tokens), min(1.0, budget)), budget * tokens.sum()
    for _ in range(rounds):
        before = p
        for at, share in zip(codes, targets):
            now = np.bincount(at, p * tokens, len(share)).astype(float)
            p = np.minimum(1.0, p * np.divide(share * total, now, out=np.ones_like(now), where=now > 0)[at])
        if np.abs(p - before).max(initial=0) < tolerance:
            break
    return p


def rake_table(facts: DataFrame, shares: dict[str, DataFrame], budget: float, rounds: int = 100,
               tolerance: float = 1e-6) -> DataFrame:
    """``facts`` (a column per axis, tokens) with ``p``, raked as a table: per
    axis, a grouped sum is joined back.  ``shares``: (class, share) per axis."""
    total = (facts.agg(F.sum("tokens").alias("n")).first()["n"] or 0) * budget
    now = facts.withColumn("p", F.lit(min(1.0, budget)))
    for _ in range(rounds):
        now = now.withColumn("before", F.col("p"))
        for axis, share in shares.items():
            factor = (now.groupBy(axis).agg(F.sum(F.col("p") * F.col("tokens")).alias("now")).join(share, axis)
                      .select(axis, F.when(F.col("now") > 0, F.col("share") * total / F.col("now"))
                              .otherwise(F.lit(1.0)).alias("factor")))
            now = now.join(factor, axis).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("factor"))).drop("factor")
        now = cut(now, "raked")
        change = now.agg(F.max(F.abs(F.col("p") - F.col("before"))).alias("c")).first()["c"]
        now = now.drop("before")
        if change is None or change < tolerance:
            break
    return now


def _shares(facts: DataFrame, axis: str, wanted: dict[str, float] | None, temper: float) -> DataFrame:
    """(class, share) of an axis: the wanted ones; the others share what is left
    by their tokens, or all get their observed shares to the power ``temper``."""
    seen = facts.groupBy(axis).agg(F.sum("tokens").cast("double").alias("n"))
    if wanted is None:
        raised = F.pow(F.col("n"), temper)
        total = cut(seen, "classes").agg(F.sum(raised).alias("s")).first()["s"] or 1.0
        return seen.select(axis, (raised / total).alias("share"))
    named = facts.sparkSession.createDataFrame(list(wanted.items()), f"{axis} string, wanted double")
    both = cut(named.join(seen, axis, "full"), "classes")
    unknown = [r[axis] for r in both.where("n IS NULL").select(axis).collect()]  # at most those the caller names
    if unknown:
        raise ValueError(f"targets for {axis} name classes that are not in the table: {sorted(unknown)}")
    sums = both.agg(F.sum("wanted").alias("named"), F.sum(F.when(F.col("wanted").isNull(), F.col("n"))).alias("free")).first()
    rest = max(0.0, 1 - (sums["named"] or 0.0))
    share = F.coalesce("wanted", F.col("n") * (rest / (sums["free"] or 1.0)))
    total = both.agg(F.sum(share).alias("s")).first()["s"] or 1.0
    return both.select(axis, (share / total).alias("share"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None,
        temper: dict[str, float] | None = None, budget: float = 0.8, topics: int = 8,
        seed: int = 11, centres: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``topic``, ``tokens``, ``weight`` (probability over budget),
    ``probability`` and ``selected``, under names that don't clash: a column of
    that name in ``df`` gives way to ``<name>_mix``.

    ``targets``: per axis ("source", "lang", "topic") the wanted shares by
    class (topics by number as text); classes not named share what is left by
    their tokens; a name that is not in the table is an error.  An axis without
    targets gets its observed shares to the power ``temper[axis]``, made to sum
    to one.

    Defined cases: null sources and languages are classes of their own; a null
    or empty text counts one token; rows with a null id are drawn by their text;
    repeated rows are drawn alike; an empty table gives an empty result."""
    temper = {"source": 0.7, "lang": 0.7, "topic": 0.8} | (temper or {})
    centres = fit_topics(df, text_col, id_col, topics) if centres is None else centres
    rows = annotate(df, centres, text_col)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(_NULL))
    facts = rows.select(source.alias("source"), lang.alias("lang"), F.col("__topic").cast("string").alias("topic"),
                        "__tokens")
    facts = cut(facts.groupBy(*AXES).agg(F.sum("__tokens").alias("tokens")), "cells")
    cells = facts.count()
    shares = {a: _shares(facts, a, (targets or {}).get(a) if cells else None, temper[a]) for a in AXES}
    if cells <= DRIVER_CELLS:
        places = F.broadcast(_raked_in_driver(facts, shares, budget))
    else:
        places = rake_table(facts, shares, budget)
    places = places.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"),
                           F.col("p").alias("__p"))
    keyed = rows.withColumn("__s", source).withColumn("__l", lang).withColumn("__t", F.col("__topic").cast("string"))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00"), F.coalesce(F.col(text_col), F.lit(""))))
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = keyed.join(places, ["__s", "__l", "__t"], "left")

    def named(name):
        return name if name not in df.columns else f"{name}_mix"
    return out.select(*[F.col(c) for c in df.columns], F.col("__topic").alias(named("topic")),
                      F.col("__tokens").alias(named("tokens")), (F.col("__p") / budget).alias(named("weight")),
                      F.col("__p").alias(named("probability")), (draw < F.col("__p")).alias(named("selected")))


def _raked_in_driver(facts: DataFrame, shares: dict[str, DataFrame], budget: float) -> DataFrame:
    """``facts`` with ``p``; there are at most DRIVER_CELLS rows."""
    cells = sorted(tuple(r) for r in facts.select(*AXES, "tokens").collect())
    codes, targets = [], []
    for i, a in enumerate(AXES):
        share = {r[a]: r["share"] for r in shares[a].collect()}
        names = sorted(share)
        place = {x: k for k, x in enumerate(names)}
        codes.append(np.array([place[c[i]] for c in cells], np.int64))
        targets.append(np.array([share[x] for x in names], float))
    p = rake_cells(codes, np.array([c[3] for c in cells], float), targets, budget)
    return facts.sparkSession.createDataFrame([(*c[:3], float(x)) for c, x in zip(cells, p)],
                                              "source string, lang string, topic string, p double")


def sample(df: DataFrame, **params) -> DataFrame:
    """The sampled rows of ``df``, all columns; cases as in ``mix``."""
    out = mix(df, **params)
    return out.where(F.col("selected_mix" if "selected" in df.columns else "selected")).select(*df.columns)
