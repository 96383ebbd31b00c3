"""TF-IDF and truncated SVD over text columns.

Tokens and n-grams are array expressions.  Texts are dealt to parts once, so
the counts per (document, term), per (part, term) and the document norms need
no further shuffle.  The vocabulary shuffles only terms that are frequent enough
in some part to be in it (``frequent_stats``).  The SVD passes over the rows, each a partial product per task, until its residual
is small; both it and the projection take a document's terms and weights as two
arrays (``document_rows``) and hold one document's share at a time.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .parallel import released, spread

# Python's \w on str is "alphanumeric or underscore": letters, numbers and
# '_' (Java's (?U)\w also takes marks and connector punctuation).  Maximal
# runs of it are exactly the \b\w+\b matches.
TOKEN_RE = "[\\p{L}\\p{N}_]+"


# Combining marks, collected by rule from the Unicode database.
_COMBINING = {c: None for c in range(0x110000) if unicodedata.combining(chr(c))}


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKD, then drop combining marks (the 'unicode' accent strip).
    Arrow-batched; the only Python step on the text path, see ``_stripped``."""
    def one(x):
        if x is None or x.isascii():
            return x
        return unicodedata.normalize("NFKD", x).translate(_COMBINING)
    return s.map(one)


def _stripped(text: Column) -> Column:
    """``text`` in lower case without accents.  Only texts with other characters
    than ASCII pass through Python; the others have none to strip."""
    low = F.lower(text)
    plain = F.octet_length(low) == F.char_length(low)
    return F.coalesce(F.when(plain, low), strip_accents(F.when(~plain, low)))


def word_tokens(text) -> Column:
    """lower-case, strip accents, extract word runs."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(_stripped(t), F.lit(TOKEN_RE), 0)


def with_ngrams(df: DataFrame, tokens: str, out: str = "grams", n_min: int = 1,
                n_max: int = 3) -> DataFrame:
    """Add ``out``: the 1..3-grams of ``tokens`` in order (n-major, like the
    reference's analyzer), each a space-joined string."""
    from pyspark.ml.feature import NGram
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(F.col(tokens))
            continue
        df = NGram(n=n, inputCol=tokens, outputCol=f"__g{n}").transform(df)
        parts.append(F.col(f"__g{n}"))
    return df.withColumn(out, F.concat(*parts)).drop(*[f"__g{n}" for n in range(2, n_max + 1)])


def with_tokens(docs: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
    """Tokens in their own column (array lambdas may not wrap the UDF)."""
    norm = docs.withColumn("__norm", _stripped(F.col(text_col)))
    return norm.withColumn(out, F.regexp_extract_all(F.col("__norm"), F.lit(TOKEN_RE), 0)).drop("__norm")


#: Name of a document's part: one value a shuffle partition.
PART = "__part"
#: Name of a document's tokens beside its grams, and the longest of these.
TOKENS, N_MAX = "__tokens", 3


def _part_names(spark, n: int) -> list[int]:
    """A number per shuffle partition that Spark's hash sends there (n of them;
    40 n numbers are tried, which leaves none of them without)."""
    tried = spark.range(40 * n, numPartitions=1).select(F.col("id").cast("int").alias("name"))
    tried = tried.groupBy(F.pmod(F.hash("name"), F.lit(n)).alias("to")).agg(F.min("name").alias("name"))
    return sorted(r["name"] for r in tried.collect())


def dealt(docs: DataFrame, id_col: str) -> DataFrame:
    """The documents dealt evenly by id to as many parts as there are shuffle
    partitions, one part a partition, with the part's name in ``PART``: what is
    grouped by it and anything else needs no shuffle."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = F.array(*[F.lit(v) for v in _part_names(docs.sparkSession, n)])
    place = F.pmod(F.xxhash64(id_col), F.size(names)).cast("int")
    return docs.withColumn(PART, names[place]).repartition(n, PART)


def doc_keys(df: DataFrame, id_col: str) -> list[str]:
    """What names a document in a table dealt to parts or not."""
    return [PART, id_col] if PART in df.columns else [id_col]


def doc_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, doc, tokens) of each document, dealt to parts; the tokens are one
    text with a space between them (no token holds one), as large as the
    document's, so a caller that needs grams twice may keep it.  Tokens are dealt,
    not texts: a Python step doesn't pass on how its rows are dealt."""
    tokens = with_tokens(spread(docs.select(id_col, text_col)), text_col, "__tok")
    return dealt(tokens.select(id_col, F.array_join("__tok", " ").alias("__tok")), id_col)


def token_grams(tokens: DataFrame, id_col: str, n_max: int = N_MAX) -> DataFrame:
    """(part, doc, tokens, grams): ``doc_tokens`` as ``TOKENS`` and their
    1..n_max-grams, in order.  Only what is used of it is made."""
    words = F.when(F.col("__tok") == "", F.array().cast("array<string>")).otherwise(F.split("__tok", " "))
    tokens = tokens.withColumn(TOKENS, F.col("__tok")) if n_max == N_MAX else tokens
    return with_ngrams(tokens.withColumn("__tok", words), "__tok", "grams", 1, n_max).select(
        *[c for c in tokens.columns if c in (PART, id_col, TOKENS)], "grams")


def doc_grams(docs: DataFrame, id_col: str, text_col: str, n_max: int = 3) -> DataFrame:
    """(part, doc, grams): the 1..n_max-grams of each document, in order, dealt
    to parts."""
    return token_grams(doc_tokens(docs, id_col, text_col), id_col, n_max)


def _terms(grams: DataFrame, id_col: str) -> DataFrame:
    """A row per gram.  explode_outer: a plain explode makes Catalyst infer a
    size(...) > 0 filter and push it, with the Python accent strip, below the
    exchange."""
    rows = grams.select(*doc_keys(grams, id_col), F.explode_outer("grams").alias("term"))
    return rows.where(F.col("term").isNotNull())


def term_counts(grams: DataFrame, id_col: str, vocab: DataFrame | None = None) -> DataFrame:
    """(part, doc, term, tf), restricted to the vocabulary when one is given
    (a broadcast semi-join on terms of a checked size).  The count runs in the
    document's part."""
    g = _terms(grams, id_col)
    if vocab is not None:
        g = g.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return g.groupBy(*doc_keys(grams, id_col), "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df, cf) from (doc, term, tf): documents containing the term and
    its total count, combined map-side."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


#: One term in so many is counted first, to guess the least count of the vocabulary.
TERM_SAMPLE = 64
#: Candidate terms are broadcast up to this size; beyond it all terms are shuffled.
CANDIDATE_BYTES = 64 << 20


def _in_range(stats: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most ``max_df`` of them."""
    high = max_df * n_docs if isinstance(max_df, float) else max_df
    return stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(high))))


def frequent_stats(grams: DataFrame, id_col: str, n_docs: int, max_features: int = 12000, min_df: int = 1,
                   max_df: float = 0.7) -> DataFrame:
    """(term, df, cf) of terms among which the vocabulary's surely are, without a
    shuffle of all terms; ``grams`` is dealt to parts.

    1. The terms of one hash class in ``TERM_SAMPLE`` are counted; their ranks
       suggest a total count ``bound`` that a little over ``max_features`` terms reach.
    2. (A task counts the grams of its part as numbers of words, see ``_Words``.)
       A term of ``bound`` occurrences has ``bound`` / parts of them in some part, so
       terms below that everywhere are left out; of the others those whose
       occurrences seen, and at most so many less one in each part where they were
       not, can make ``bound`` are the candidates.
    3. The candidates are counted exactly.  All terms of at least ``bound`` are among
       them, so if ``max_features`` of these are in range, the vocabulary is too;
       otherwise ``bound`` is halved.

    Where ``bound`` / parts is no more than 1 (few documents) or the candidates are
    larger than ``CANDIDATE_BYTES``, all terms are counted by one shuffle."""
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = int(1.2 * max_features / TERM_SAMPLE) + 8
    some = term_stats(_sampled_counts(grams, id_col))
    top = _in_range(some, n_docs, min_df, max_df).orderBy(F.col("cf").desc()).limit(wanted)
    least = top.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
    bound = least["cf"] if least["n"] == wanted else 0
    while bound > parts:
        share = -(-bound // parts)
        here = grams.select(TOKENS).mapInArrow(_frequent_here(share), "term string, cf long")
        seen = here.groupBy("term").agg(F.sum("cf").alias("cf"), F.count(F.lit(1)).alias("n"))
        possible = seen.where(F.col("cf") + (parts - F.col("n")) * (share - 1) >= bound)
        candidates = cut_lineage(possible.select("term"))
        size = candidates.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
        if size > CANDIDATE_BYTES:
            break
        exact = cut_lineage(_exact_stats(grams, id_col, candidates).where(F.col("cf") >= bound))
        if _in_range(exact, n_docs, min_df, max_df).count() >= max_features:
            return exact
        bound //= 2
    return term_stats(term_counts(grams, id_col))


def _sampled_counts(grams: DataFrame, id_col: str) -> DataFrame:
    """(doc, term, tf) of the terms of one hash class, named by 64-bit hashes."""
    @released
    def run(batches):
        part = _Words(batches, "id")
        if not len(part.number):
            return
        h = pd.util.hash_array(part.words.to_numpy(zero_copy_only=False), categorize=False)[part.number]
        for n in range(1, N_MAX + 1):
            key = np.full(max(0, len(h) - n + 1), n, np.uint64)
            for k in range(n):
                key = (key ^ h[k:len(key) + k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            inside = part.inside(n) & (key % np.uint64(TERM_SAMPLE) == 0)
            doc, term, tf = _count_pairs(part.doc[:len(key)][inside], key[inside].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.ids.take(pa.array(doc)), pa.array(term), pa.array(tf)], [id_col, "term", "tf"])
    kind = grams.schema[id_col].dataType
    return grams.select(F.col(id_col).alias("id"), TOKENS).mapInArrow(
        run, StructType([StructField(id_col, kind), StructField("term", LongType()), StructField("tf", LongType())]))


def _count_pairs(doc: np.ndarray, term: np.ndarray):
    """(doc, term, count) of the pairs there are."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


class _Words:
    """The words of one part's documents in order: the document and the number of
    each in ``words``, and the documents' ``ids`` (rows of one id are one document)."""

    def __init__(self, batches, id_col: str | None = None):
        batches = list(batches)
        t = pa.Table.from_batches(batches) if batches else pa.table({TOKENS: pa.array([], pa.string())})
        t = t.filter(pc.greater(pc.binary_length(t.column(TOKENS)), 0))  # null and empty ones have none
        lists = pc.split_pattern(t.column(TOKENS).cast(pa.large_string()).combine_chunks(), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        row = np.repeat(np.arange(len(t), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        self.words, self.number = coded.dictionary, coded.indices.to_numpy()
        self.row = self.doc = row
        if id_col and id_col in t.column_names:
            ids = t.column(id_col).combine_chunks()
            same = ids.dictionary_encode(null_encoding="encode")
            self.ids, self.doc = same.dictionary, same.indices.to_numpy()[row]

    def inside(self, n: int) -> np.ndarray:
        """Which places begin ``n`` words of one row."""
        m = max(0, len(self.row) - n + 1)
        return self.row[:m] == self.row[n - 1:n - 1 + m]


def _joined(words, numbers) -> pa.Array:
    """Terms of the words that each column of ``numbers`` names."""
    return pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in numbers], pa.scalar(" ", words.type)) \
        if len(numbers) > 1 else words.take(pa.array(numbers[0]))


def _counted(key: np.ndarray, least: int):
    """(value, count) of what is there at least ``least`` times, sorted; ``key`` is sorted too."""
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return key[first[count >= least]], count[count >= least]


def _frequent_here(least: int):
    """(term, cf) of a part's terms of at least ``least`` occurrences there: a gram
    has no more of them than its words and the gram without its last word."""
    def batch(words, numbers, count):
        return pa.RecordBatch.from_arrays([_joined(words, numbers).cast(pa.string()), pa.array(count)], ["term", "cf"])

    @released
    def run(batches):
        part = _Words(batches)
        v, low = part.number, 0xFFFFFFFF
        count = np.bincount(v, minlength=len(part.words))
        often = np.flatnonzero(count >= least)
        yield batch(part.words, [often], count[often])
        good = (count >= least)[v]
        at = np.flatnonzero(part.inside(2) & good[:-1] & good[1:])
        pairs, count = _counted(v[at].astype(np.int64) << 32 | v[at + 1], least)
        if not len(pairs):
            return
        yield batch(part.words, [pairs >> 32, pairs & low], count)
        at = at[np.append(part.inside(3), False)[at]]
        at = at[good[at + 2]]
        key = v[at].astype(np.int64) << 32 | v[at + 1]
        pair = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        known = pairs[pair] == key
        key, count = _counted(pair[known] << 32 | v[at[known] + 2], least)
        first = pairs[key >> 32]
        yield batch(part.words, [first >> 32, first & low, key & low], count)
    return run


class _Terms:
    """Terms that texts are searched for, as numbers of their words."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.words = sorted({w for t in split for w in t})
        number = {w: i + 1 for i, w in enumerate(self.words)}
        if len(self.words) >= 1 << 21:
            raise ValueError("the terms have too many words")
        key = np.array([sum(number[w] << 42 - 21 * k for k, w in enumerate(t)) for t in split], np.int64)
        self.place = np.argsort(key)
        self.key = key[self.place]

    def found(self, part: _Words):
        """(document, place of the term, tf) in a part's texts, by document and term."""
        if not len(self.key) or not len(part.number):
            return [np.zeros(0, np.int64)] * 3
        code = pc.index_in(part.words, value_set=pa.array(self.words, part.words.type))
        v = (pc.fill_null(code, -1).to_numpy() + np.int32(1))[part.number]
        docs, terms = [], []
        for n in range(1, N_MAX + 1):
            m = max(0, len(v) - n + 1)
            good = part.inside(n)
            for k in range(n):
                good = good & (v[k:k + m] > 0)
            at = np.flatnonzero(good)
            key = sum(v[at + k].astype(np.int64) << 42 - 21 * k for k in range(n))
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[place] == key
            docs.append(part.doc[at[hit]])
            terms.append(self.place[place[hit]])
        return _count_pairs(np.concatenate(docs), np.concatenate(terms))


def _exact_stats(grams: DataFrame, id_col: str, candidates: DataFrame) -> DataFrame:
    """``term_stats`` of the candidates (a bounded number), added up in the parts."""
    names = candidates.toArrow().column("term").to_pylist()
    sent = grams.sparkSession.sparkContext.broadcast((names, _Terms(names)))

    @released
    def run(batches):
        names, terms = sent.value
        _, place, tf = terms.found(_Words(batches, "id"))
        df, cf = np.bincount(place, minlength=len(names)), np.bincount(place, tf, len(names)).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some.tolist()], pa.string()), pa.array(df[some]),
                                          pa.array(cf[some])], ["term", "df", "cf"])
    here = grams.select(F.col(id_col).alias("id"), TOKENS).mapInArrow(run, "term string, df long, cf long")
    return here.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def document_weights(grams: DataFrame, vocab: DataFrame, id_col: str, n_docs: int) -> DataFrame:
    """``document_rows`` of the (sublinear) ``tfidf`` of the vocabulary's terms, which a task
    finds in its part's tokens at once."""
    rows = sorted(vocab.select("index", "term", "df").collect())     # <= max_features rows
    at, idf = np.array([r["index"] for r in rows], np.int32), np.array([1.0 + np.log((n_docs + 1) / (r["df"] + 1)) for r in rows])
    sent = grams.sparkSession.sparkContext.broadcast((_Terms([r["term"] for r in rows]), at, idf))

    @released
    def run(batches):
        terms, at, idf = sent.value
        part = _Words(batches, "id")
        doc, place, tf = terms.found(part)
        if not len(doc):
            return
        w = (1.0 + np.log(tf)) * idf[place]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, len(doc)))
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, first)), size)
        for a in range(0, len(first), 4096):
            bounds = np.append(first, len(doc))[a:a + 4097]
            some, bounds = slice(bounds[0], bounds[-1]), (bounds - bounds[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.ids.take(pa.array(doc[first[a:a + 4096]])), pa.ListArray.from_arrays(bounds, at[place[some]]),
                 pa.ListArray.from_arrays(bounds, w[some]), pa.array(np.zeros(len(bounds) - 1, bool))],
                [id_col, "i", "w", "twice"])
    return grams.select(F.col(id_col).alias("id"), TOKENS).mapInArrow(run, StructType([
        StructField(id_col, grams.schema[id_col].dataType), StructField("i", ArrayType(IntegerType())),
        StructField("w", ArrayType(DoubleType())), StructField("twice", BooleanType())]))


def vocabulary(stats: DataFrame, n_docs: int, max_features: int = 12000,
               min_df: int = 1, max_df: float = 0.7) -> DataFrame:
    """F8: keep terms with min_df <= df <= max_df * n_docs, then the
    ``max_features`` most frequent (ties by term); index = alphabetical."""
    kept = _in_range(stats, n_docs, min_df, max_df)
    top = kept.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)
    # bounded by max_features rows, so one ordering task is fine here
    return top.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def tfidf(tf: DataFrame, vocab: DataFrame, id_col: str, n_docs: int, sublinear: bool = True) -> DataFrame:
    """(part, doc, index, term, weight), L2-normalised per document.
    weight = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)."""
    v = F.broadcast(vocab.select("term", "index", "df"))     # <= max_features rows
    j = tf.join(v, "term", "inner")
    tfw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    idf = F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1).cast("double")) + F.lit(1.0)
    w = j.withColumn("w", tfw * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*doc_keys(tf, id_col))))
    return w.select(*doc_keys(tf, id_col), "index", "term", (F.col("w") / norm).alias("weight"))


def document_rows(weights: DataFrame, id_col: str) -> DataFrame:
    """(part, doc, i, w, twice) from (part, doc, index, weight): a row per document
    with its terms and their weights, and whether a term is there more than once.
    Rows of this form are returned as they are."""
    if {"i", "w", "twice"} <= set(weights.columns):
        return weights
    e = weights.groupBy(*doc_keys(weights, id_col)).agg(F.collect_list(F.struct("index", "weight")).alias("e"))
    e = e.select(*doc_keys(weights, id_col), F.col("e.index").alias("i"), F.col("e.weight").alias("w"))
    return e.withColumn("twice", F.size(F.array_distinct("i")) < F.size("i"))


def _documents(b):
    """(terms, weights) of each document of an Arrow batch of ``document_rows``."""
    i, w = b.column("i"), b.column("w")
    bounds = i.offsets.to_numpy().tolist()
    # offsets count from the start of ``values``, which is not cut with the batch
    i, w = i.values.to_numpy().astype(np.intp), w.values.to_numpy()
    return [(i[s:e], w[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]


def svd_components(weights: DataFrame, id_col: str, n_features: int, k: int = 50, passes: int = 11,
                   oversample: int = 10, seed: int = 42, tolerance: float = 1e-8, blocks: int = 12,
                   limit: int = 60) -> DataFrame:
    """top-k right singular vectors of the TF-IDF matrix (no centring) as
    (index, loadings array<double>); signs make the largest loading of each
    component positive.

    Block Lanczos iteration: each task adds up its part of A'(A Z) for the
    newest n_features x (k + oversample) block Z, the parts are summed by term,
    and the driver makes the product orthogonal to all blocks so far.  There are
    at least ``passes`` passes over the rows, and more until the residual
    |A'A v - s^2 v| of every component is below ``tolerance`` of the largest s^2
    or the blocks span all there is; ``limit`` passes without that are an error.  After ``blocks`` blocks the best vectors of
    their span replace them, so what the driver holds is bounded by
    max_features x (k + oversample) x 2 (blocks + 1)."""
    spark = weights.sparkSession
    k = max(1, min(k, n_features - 1))
    width = min(n_features, k + oversample)
    rows = document_rows(weights, id_col)
    rows = (rows if rows is weights else cut_lineage(rows)).select("i", "w", "twice")
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)  # one partial product a core
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, width)))[0]
    held = products = np.zeros((n_features, 0))
    done = 0
    while True:
        product = _normal_product(spark, rows, basis)
        done += 1
        held, products = np.hstack((held, basis)), np.hstack((products, product))
        small = held.T @ products                       # Z' A'A Z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:width]
        values, turn = values[order], turn[:, order]
        components = held @ turn[:, :k]
        residual = np.linalg.norm(products @ turn[:, :k] - components * values[:k], axis=0).max()
        if done >= passes and residual <= tolerance * values[0]:
            break
        if done >= limit:
            raise RuntimeError(f"the SVD's residual is {residual / max(values[0], 1e-300):.2g} of the largest "
                               f"eigenvalue after {limit} passes, above {tolerance:.2g}")
        for _ in range(2):
            product = product - held @ (held.T @ product)
        left, sizes, _ = np.linalg.svd(product, full_matrices=False)
        basis = left[:, sizes > 1e-12 * max(values[0], 1e-300)][:, :n_features - held.shape[1]]
        if not basis.shape[1]:
            break
        basis = np.linalg.qr(basis - held @ (held.T @ basis))[0]
        if held.shape[1] >= blocks * width:
            held, products = held @ turn, products @ turn
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    components *= np.where(signs == 0, 1.0, signs)
    table = pd.DataFrame({"index": np.arange(n_features, dtype="int32"), "loadings": components.tolist()})
    return spark.createDataFrame(table, "index int, loadings array<double>")


#: Terms of a block of rows of a product.
_ROWS = 512
#: Bytes of partial products that the driver adds up itself; more are added by a
#: shuffle first, whose files stay for all passes.
_DRIVER_BYTES = 128 << 20


def _normal_product(spark, rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'(A Z), summed over the rows' partitions by blocks of terms."""
    sent, width = spark.sparkContext.broadcast(basis), basis.shape[1]
    form, schema = "block int, sums binary", ["block", "sums"]

    def part(batches):
        z = sent.value
        total, seen = np.zeros_like(z), False
        for b in batches:
            for (at, w), twice in zip(_documents(b), b.column("twice").to_pylist()):
                # a document at a time: its rows of Z stay in the cache
                back = w[:, None] * (w @ z.take(at, axis=0))
                if twice:
                    np.add.at(total, at, back)
                else:
                    back += total.take(at, axis=0)
                    total[at] = back
                seen = True
        for at in range(0, len(total) if seen else 0, _ROWS):
            some = total[at:at + _ROWS]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // _ROWS], pa.int32()), pa.array([some.tobytes()])], schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, one in zip(b.column("block").to_pylist(), b.column("sums")):
                one = np.frombuffer(one.as_buffer())
                sums[block] = sums[block] + one if block in sums else one.copy()
        for block, one in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([one.tobytes()])], schema)
    parts = rows.mapInArrow(part, form)
    if rows.rdd.getNumPartitions() * basis.nbytes > _DRIVER_BYTES:
        parts = parts.repartition("block").mapInArrow(add, form)
    got = parts.toArrow()
    sent.destroy()  # and its file
    out = np.zeros_like(basis)
    for block, one in zip(got.column("block").to_pylist(), got.column("sums")):
        out[block * _ROWS:(block + 1) * _ROWS] += np.frombuffer(one.as_buffer()).reshape(-1, width)
    return out


def svd_project(weights: DataFrame, comps: DataFrame, id_col: str, k: int, out: str = "components") -> DataFrame:
    """X . V: (id, array of k components) of each document.  ``weights``: by term,
    or ``document_rows`` of them."""
    found = comps.toPandas()                           # <= max_features rows of k numbers
    loadings = np.zeros((int(found["index"].max()) + 1, k))
    loadings[found["index"].to_numpy()] = np.array(found["loadings"].to_list())[:, :k]
    sent = weights.sparkSession.sparkContext.broadcast(loadings)

    def part(batches):
        v = sent.value
        for b in batches:
            sums = np.array([w @ v.take(at, axis=0) for at, w in _documents(b)]).ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * k, sums)],
                [id_col, out])
    rows = document_rows(weights, id_col).select(id_col, "i", "w")
    return rows.mapInArrow(part, StructType([StructField(id_col, rows.schema[id_col].dataType),
                                             StructField(out, ArrayType(DoubleType()))]))
