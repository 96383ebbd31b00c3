"""Quality classifier (9): nearest-neighbour voting in a latent space.

Texts become weighted counts of hashed byte trigrams and word shapes; the
inverse document frequencies cover all documents.  A truncated SVD of a
bounded, labelled reference sample gives the latent space; the references'
latent vectors (``per_class`` a label) are broadcast, every document's cosine
with each of them is computed in blocks, and the labels of the ``neighbours``
nearest vote with weights that rise with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import SHAPES, TRIGRAMS, parts, raw, shapes, trigrams
from .storage import text_column

WIDTH = TRIGRAMS + SHAPES


@dataclass
class Model:
    idf: np.ndarray  # (WIDTH,)
    basis: np.ndarray  # (WIDTH, dims)
    vectors: np.ndarray  # (references, dims) of length one
    labels: np.ndarray  # (references,) 0 or 1


def counts(texts: pa.LargeStringArray) -> np.ndarray:
    data, bounds = raw(texts)
    return np.concatenate((trigrams(data, bounds), shapes(data, bounds)), axis=1).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each block of features has length one, so neither outweighs the other."""
    a, b = np.log1p(n[:, :TRIGRAMS]), n[:, TRIGRAMS:] / np.maximum(n[:, TRIGRAMS:].sum(axis=1, keepdims=True), 1)
    return np.concatenate((_unit(a * idf[:TRIGRAMS]), _unit(np.sqrt(b) * idf[TRIGRAMS:])), axis=1).astype(np.float32)


def document_frequencies(df: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each feature, over all rows."""
    def run(batches):
        total, seen = 0, np.zeros(WIDTH, np.int64)
        for b in batches:
            texts = text_column(b, "text")
            for a, z in parts(texts, 4 << 20):
                seen += (counts(texts.slice(a, z - a)) > 0).sum(axis=0)
            total += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH)), pa.array(np.append(total, seen))],
                                         ["feature", "n"])
    found = (df.select(F.col(text_col).alias("text")).mapInArrow(run, "feature long, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")).collect())  # WIDTH + 1 rows
    out = np.zeros(WIDTH + 1, np.int64)
    for r in found:
        out[r["feature"]] = r["n"]
    return int(out[-1]), out[:-1]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = 2048, dims: int = 64) -> Model:
    """``labels``: the labelled rows that may be learned from.  References are
    the ``per_class`` rows of each label with the smallest hash of their id, a
    documented bound.  Rows with a null id or a label other than 0 and 1 are
    ignored; of several labels of a document the smaller counts."""
    n, seen = document_frequencies(df, text_col)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    known = labels.groupBy(id_col).agg(F.min(label_col).alias("label")).where(F.col(id_col).isNotNull())
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        picked = part if picked is None else picked.union(part)

    def featurise(batches):
        for b in batches:
            x = weighted(counts(text_column(b, "text")), idf)
            yield pa.RecordBatch.from_arrays(
                [b.column("label").cast(pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["label", "x"])
    # at most 2 * per_class rows of WIDTH numbers reach the driver
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = picked.select(F.col(id_col).alias("id"), "label")
    got = (texts.join(F.broadcast(picked), "id").dropDuplicates(["id"]).select("label", "text")
           .mapInArrow(featurise, "label long, x binary")
           .orderBy(F.xxhash64("x"), "x").collect())
    if not got:
        return Model(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :dims]).astype(np.float32)
    return Model(idf, basis, _unit(x @ basis).astype(np.float32), np.array([r["label"] for r in got], np.float32))


def vote(x: np.ndarray, model: Model, neighbours: int, sharpness: float) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest references; the
    references' share of label 1 where nothing is similar or known."""
    prior = float(model.labels.mean()) if len(model.labels) else 0.5
    out = np.full(len(x), prior)
    if not len(model.labels):
        return out
    latent = x @ model.basis
    there = np.linalg.norm(latent, axis=1) > 1e-9
    k = min(neighbours, len(model.labels))
    for at in range(0, len(x), 512):
        near = _unit(latent[at:at + 512]) @ model.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        similar = np.take_along_axis(near, top, axis=1).astype(np.float64)
        weight = np.exp(sharpness * (similar - 1))
        out[at:at + 512] = (weight * model.labels[top]).sum(axis=1) / weight.sum(axis=1)
    out[~there] = prior
    return np.clip(out, 0.0, 1.0)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 25,
          sharpness: float = 10.0, carry: list[Column] = ()) -> DataFrame:
    """One row per input row: ``id_col``, the ``carry`` columns, ``score`` (0 to
    1, higher: label 1 likelier) and ``predicted`` (1 if score >= 0.5).

    Defined cases: null and empty texts, and all texts if nothing was learned,
    get the references' share of label 1; repeated rows each get a row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col), *carry, F.col(text_col).alias("__text"))
    kept = rows.schema.names[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        m = sent.value
        for b in batches:
            texts = text_column(b, "__text")
            for a, z in parts(texts, 4 << 20):
                s = vote(weighted(counts(texts.slice(a, z - a)), m.idf), m, neighbours, sharpness)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(a, z - a) for c in kept]
                    + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], kept + ["score", "predicted"])
    return rows.mapInArrow(run, schema + ", score double, predicted int")
