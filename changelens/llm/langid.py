"""Language ID (3): script ranges, per-word scores, Viterbi over words.

The model holds, per language, log probabilities of hashed letter 1- to
4-grams of words and the scripts the language is written in.  A word's script
(from ranges of code points) leaves only languages of that script as
candidates; its n-grams score those; a Viterbi pass with a penalty for every
change of language labels the words, and runs of equal labels are the spans of
a mixed-language text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import text_column, tidy
from .tokens import slices

#: First code points of script ranges, each up to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
BUCKETS = 1 << 15
#: Bytes of text scored at once; a worker's arrays are some 40 times that.
SLICE_BYTES = 1 << 20
_ORDERS = (1, 2, 3, 4)
#: A language's script is one that holds this share of its letters.
SCRIPT_SHARE = 0.01
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages) log probabilities
    scripts: np.ndarray  # (scripts, languages) is the script used by the language


class Words:
    """The distinct words of some texts as letters, n-grams and scripts."""

    def __init__(self, texts: pa.LargeStringArray):
        parts = pc.split_pattern_regex(pc.utf8_lower(texts), r"[\x09-\x0d\x20]+")
        flat = pc.list_flatten(parts).dictionary_encode()
        self.of = flat.indices.to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy()))).astype(np.int64)
        words = flat.dictionary
        self.n = len(words)
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(self.n), lengths)
        keep = _letter_table()[points]
        self.points, self.word = points[keep], word[keep]
        self.letters = np.bincount(self.word, minlength=self.n)
        script = _SCRIPT_OF[np.searchsorted(_STARTS, self.points, "right") - 1]
        counts = np.bincount(self.word * len(_NAMES) + script, minlength=self.n * len(_NAMES)).reshape(self.n, -1)
        self.script = counts.argmax(axis=1)

    def grams(self):
        """(bucket, word) of all n-grams, the word's edges marked."""
        size = self.letters + 2 * (self.letters > 0)
        ends = np.cumsum(size)
        padded = np.full(int(size.sum()), 1, np.int64)  # 1 marks an edge
        first = np.cumsum(self.letters) - self.letters
        padded[(ends - size + 1)[self.word] + np.arange(len(self.word)) - first[self.word]] = self.points
        word = np.repeat(np.arange(self.n), size)
        for order in _ORDERS:
            if len(padded) < order:
                continue
            same = word[:len(word) - order + 1] == word[order - 1:]
            mixed = np.full(len(padded) - order + 1, order, np.uint64)
            for k in range(order):
                mixed = (mixed ^ padded[k:len(padded) - order + 1 + k].astype(np.uint64)) * np.uint64(
                    0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            yield (mixed[same] >> np.uint64(20)).astype(np.int64) % BUCKETS, word[:len(word) - order + 1][same]


def train(df: DataFrame, text_col: str, lang_col: str, id_col: str, sample_rows: int = 20000) -> Model:
    """Fit the model on the rows given, or on a hash sample of about
    ``sample_rows`` of them (a bound on the labelled rows, not on texts).
    Rows with a null label are ignored.  What comes to the driver is bounded by
    languages x buckets."""
    rows = df.where(F.col(lang_col).isNotNull())
    n = rows.count()
    if n > sample_rows:
        cut_at = int(sample_rows / n * 1_000_000)
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1_000_000)) < cut_at)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for b in batches:
            texts, langs = text_column(b, "text"), b.column("lang").to_pylist()
            for a, z in slices(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                words = Words(texts.slice(a, z - a))
                grams = list(words.grams())
                doc = np.repeat(np.arange(z - a), np.diff(words.bounds))
                labels = sorted(set(langs[a:z]))
                label = np.array([labels.index(x) for x in langs[a:z]])[doc]
                for i, lang in enumerate(labels):
                    weight = np.bincount(words.of[label == i], minlength=words.n).astype(float)
                    total = sum(np.bincount(g, weights=weight[w], minlength=BUCKETS) for g, w in grams)
                    seen = np.flatnonzero(total)
                    by_script = np.bincount(words.script, weights=weight * words.letters, minlength=len(_NAMES))
                    found = np.flatnonzero(by_script)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * (len(seen) + len(found)), pa.string()),
                         pa.array(np.concatenate((seen, -1 - found))),
                         pa.array(np.concatenate((total[seen], by_script[found])))], ["lang", "bucket", "n"])

    counted = (rows.mapInArrow(count, "lang string, bucket long, n double")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counted["lang"].unique())
    scores = np.full((BUCKETS, len(languages)), 0.5)
    scripts = np.zeros((len(_NAMES), len(languages)))
    for i, lang in enumerate(languages):
        part = counted[counted["lang"] == lang]
        at, n = part["bucket"].to_numpy(), part["n"].to_numpy()
        scores[at[at >= 0], i] += n[at >= 0]
        scripts[-1 - at[at < 0], i] = n[at < 0]
    scores = np.log(scores) - np.log(scores.sum(axis=0, keepdims=True))
    scripts = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(languages, scores.astype(np.float32), scripts)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(words, languages); languages not written in the word's script get the
    lowest score of the word less a fixed 20; words without letters get 0."""
    out = np.zeros((words.n, len(model.languages)), np.float32)
    for bucket, word in words.grams():
        if len(word):
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[heads]] += np.add.reduceat(model.scores[bucket], heads, axis=0)
    out -= out.max(axis=1, keepdims=True, initial=-np.inf) if len(model.languages) else 0
    fits = model.scripts[words.script]
    fits[~fits.any(axis=1)] = True
    out[~fits] = out.min(initial=0) - 20
    out[words.letters == 0] = 0
    return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word of many texts at once.  ``scores`` has the words
    of all texts in order, ``bounds`` each text's first word and the end."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = bounds[:-1][order], lengths[order]
    n, k = len(scores), scores.shape[1]
    stay, best = np.zeros((n, k), bool), np.zeros(n, np.int16)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts longer than t
    v = np.zeros((len(sizes), k), np.float32)
    for t in range(steps):
        m = active[t]
        at = starts[:m] + t
        if t:
            top = v[:m].argmax(axis=1)
            jump = v[np.arange(m), top][:, None] - penalty
            stay[at] = v[:m] >= jump
            best[at] = top
            v[:m] = np.maximum(v[:m], jump)
        v[:m] += scores[at]
    out = np.zeros(n, np.int16)
    now = v.argmax(axis=1).astype(np.int16) if len(sizes) else None
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        out[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], best[at])
    return out


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def label(texts: pa.LargeStringArray, model: Model, penalty: float):
    """Per text: place of the language in ``model.languages`` (their number if
    there is none) and score; the spans as a list array; and the share of letters
    in words of a script that some language uses."""
    k, docs = len(model.languages), len(texts)
    words = Words(texts)
    doc = np.repeat(np.arange(docs), np.diff(words.bounds))
    best = (viterbi(word_scores(words, model)[words.of], words.bounds, penalty) if k
            else np.zeros(len(words.of), np.int16))
    letters = np.bincount(doc * max(k, 1) + best, weights=words.letters[words.of],
                          minlength=docs * max(k, 1)).reshape(docs, -1)
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    top[(total == 0) | (k == 0)] = k
    score = letters.max(axis=1) / np.maximum(total, 1) * (top < k)
    used = words.letters * model.scripts.any(axis=1)[words.script] if k else words.letters * 0
    known_share = np.bincount(doc, weights=used[words.of], minlength=docs) / np.maximum(total, 1)
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(best))[:len(first)]
    known = top[doc[first]] < k
    first, ends = first[known], ends[known]
    flat = pa.StructArray.from_arrays(
        [pa.array(first - words.bounds[doc[first]]), pa.array(ends - words.bounds[doc[first]]),
         pa.array([model.languages[i] for i in best[first].tolist()], pa.string())], fields=list(_SPAN))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=docs))))
    return top, score, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), known_share


def _types(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0,
            carry: list[Column] = (), with_spans: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, the ``carry`` columns, ``lang_pred``
    (the language with most letters; the first by name of ties), ``score`` (its
    share of the letters) and ``spans``: first word, end word, language of each
    run of words in one language.

    Defined cases: a null text, an empty text or one without a letter gives
    ``und`` with score 0 and no spans, and so does any text if no language was
    learned; repeated rows each get a row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col), *carry, F.col(text_col).alias("__text"))
    kept = rows.schema.names[:-1]
    out_type = _types(rows.drop("__text").schema) + ", lang_pred string, score double"
    if with_spans:
        out_type += ", spans array<struct<first: bigint, end: bigint, lang: string>>"

    def run(batches):
        names = sent.value.languages + ["und"]
        for b in batches:
            texts = text_column(b, "__text")
            for a, z in slices(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                top, score, spans, _ = label(texts.slice(a, z - a), sent.value, penalty)
                cols = [b.column(c).slice(a, z - a) for c in kept]
                cols += [pa.array([names[i] for i in top.tolist()], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols + [spans] * with_spans,
                                                 kept + ["lang_pred", "score"] + ["spans"] * with_spans)
    return rows.mapInArrow(tidy(run), out_type)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5,
                    penalty: float = 12.0) -> DataFrame:
    """The rows of ``df`` that have letters, at least ``least`` of them in words
    of a script that a learned language uses; a text in several known languages
    stays, however they share it.

    Defined cases: null and empty texts, and those without letters, go; repeated
    rows stay alike; an empty table gives an empty result; all rows stay if no
    language was learned; all columns are kept, whatever their names."""
    if not model.languages:
        return df
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = text_column(b, text_col)
            for a, z in slices(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                top, _, _, known = label(texts.slice(a, z - a), sent.value, penalty)
                keep = (top < len(sent.value.languages)) & (known >= least)
                yield b.slice(a, z - a).filter(pa.array(keep))
    return df.mapInArrow(tidy(run), _types(df.schema))
