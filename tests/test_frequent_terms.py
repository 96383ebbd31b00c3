"""The vocabulary from terms that are frequent in some part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import text_features as TF
from changelens.session import cut_lineage_dealt


def _corpus(spark, n=600, seed=5):
    """Words of falling frequency, an everywhere word, many that occur once."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(["all", *rnd.choices(words, weights, k=40), f"once{i}"])) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (None, "w1 w2"), (7, "w1 w1")]
    return spark.createDataFrame(rows, "id long, text string")


def _grams(docs):
    return TF.token_grams(cut_lineage_dealt(TF.doc_tokens(docs, "id", "text")), "id")


@pytest.mark.parametrize("size", [1, 40, 150, 100000])
def test_vocabulary_is_that_of_all_terms(spark, size):
    docs = _corpus(spark)
    n, grams = docs.count(), _grams(docs)
    got = TF.vocabulary(TF.frequent_stats(grams, "id", n, size), n, size).collect()
    want = TF.vocabulary(TF.term_stats(TF.term_counts(grams, "id")), n, size).collect()
    assert sorted(got) == sorted(want) and "all" not in {r.term for r in got}


def test_too_high_a_guess_is_lowered_and_too_many_candidates_are_shuffled(spark, monkeypatch):
    docs = _corpus(spark)
    n, grams = docs.count(), _grams(docs)
    want = sorted(TF.vocabulary(TF.term_stats(TF.term_counts(grams, "id")), n, 100).collect())
    monkeypatch.setattr(TF, "TERM_SAMPLE", 4)
    monkeypatch.setattr(TF, "_sampled_counts", lambda g, i: TF.term_counts(g, i).withColumn("tf", F.col("tf") * 9))
    assert sorted(TF.vocabulary(TF.frequent_stats(grams, "id", n, 100), n, 100).collect()) == want
    monkeypatch.setattr(TF, "CANDIDATE_BYTES", 10)
    assert sorted(TF.vocabulary(TF.frequent_stats(grams, "id", n, 100), n, 100).collect()) == want


def test_parts_are_even_and_known_to_the_planner(spark):
    grams = _grams(_corpus(spark))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in grams.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == parts and max(sizes) < 2 * 600 / parts
    for keys in ([TF.PART, "term"], [TF.PART, "id", "term"]):
        plan = TF._terms(grams, "id").groupBy(*keys).count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_few_rows_are_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    grams = _grams(docs)
    here = TF._terms(grams, "id").groupBy(TF.PART, "term").agg(F.count(F.lit(1)).alias("cf"))
    every = here.count()                                     # rows of the shuffle of all terms
    n = docs.count()
    exact = TF.frequent_stats(grams, "id", n, 1000)
    bound = exact.agg(F.min("cf")).first()[0]
    share = -(-bound // int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = here.where(F.col("cf") >= share).count()
    again = here.join(exact.select("term"), "term", "left_semi").count()
    sampled = here.where(F.pmod(F.xxhash64("term"), F.lit(TF.TERM_SAMPLE)) == 0).count()
    assert 5 * (found + again + sampled) <= every


def test_no_documents(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert TF.vocabulary(TF.frequent_stats(_grams(docs), "id", 0), 0).count() == 0


def test_only_texts_with_other_characters_pass_through_python(spark, monkeypatch):
    texts = ["Plain TEXT", "", None, "École déjà", "naïve x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.tokens for r in TF.with_tokens(df, "text").collect()}
    assert got == {0: ["plain", "text"], 1: [], 2: None, 3: ["ecole", "deja"], 4: ["naive", "x"]}
    monkeypatch.setattr(TF, "strip_accents", lambda c: F.concat(F.lit("python "), c))
    got = {r.id: r.tokens for r in TF.with_tokens(df, "text").collect()}
    assert [k for k, v in got.items() if v and v[0] == "python"] == [3, 4]


def _odd(spark):
    """Repeated and null ids, null and empty texts, short ones, accents, in more than one part."""
    rows = [(1, "a b a b a b c"), (1, "b c a b"), (None, "a b"), (None, "c Écran a b"), (2, None), (3, ""), (4, "a"),
            (5, "écran écran"), (6, "z"), (7, "a b c a b c"), (8, "_ 9 _ 9")]
    return spark.createDataFrame(rows, "id long, text string")


def test_grams_counted_as_numbers_of_words(spark):
    grams = _grams(_odd(spark))
    counts = TF.term_counts(grams, "id").cache()
    here = counts.join(grams.select(TF.PART, "id").distinct(), [TF.PART]).select(TF.PART, "term").distinct()
    for least in (1, 2, 3):
        want = counts.groupBy(TF.PART, "term").agg(F.sum("tf").alias("cf")).where(F.col("cf") >= least)
        got = grams.select(TF.TOKENS).mapInArrow(TF._frequent_here(least), "term string, cf long")
        assert sorted(tuple(r) for r in got.collect()) == sorted((r.term, r.cf) for r in want.collect())
    some = spark.createDataFrame([("a",), ("a b",), ("b c a",), ("ecran",), ("9 _ 9",), ("not there",)], "term string")
    want = TF.term_stats(counts.join(some, "term", "left_semi"))
    got = TF._exact_stats(grams, "id", some).select("term", "df", "cf")
    assert here.count() and sorted(tuple(r) for r in got.collect()) == sorted((r.term, r.df, r.cf) for r in want.collect())


def test_document_weights_are_those_of_tfidf(spark):
    docs = _odd(spark)
    n, grams = docs.count(), _grams(docs)
    vocab = TF.vocabulary(TF.term_stats(TF.term_counts(grams, "id").where("term <> 'z'")), n, 12).cache()
    want = TF.tfidf(TF.term_counts(grams, "id", vocab), vocab, "id", n).collect()
    got = TF.document_weights(grams, vocab, "id", n)
    assert TF.document_rows(got, "id") is got
    found = {(r.id, i): w for r in got.collect() for i, w in zip(r.i, r.w)}
    assert {(r.id, r["index"]): pytest.approx(r.weight, abs=1e-12) for r in want} == found
    assert len(found) == len(want) == sum(len(r.i) for r in got.collect()) and not any(r.twice for r in got.collect())
    empty = _grams(docs.limit(0))
    assert TF.document_weights(empty, vocab, "id", n).count() == 0


@pytest.mark.parametrize("most", [0, TF._DRIVER_BYTES])
def test_products_are_summed_over_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(TF, "_DRIVER_BYTES", most)
    rows = spark.createDataFrame([([0, 1200], [1.0, 2.0], False), ([1200], [3.0], False), ([5, 5], [0.5, 0.5], True)],
                                 "i array<int>, w array<double>, twice boolean").repartition(3)
    z = np.random.default_rng(3).standard_normal((1300, 4))
    x = np.zeros((3, 1300))
    x[0, 0], x[0, 1200], x[1, 1200], x[2, 5] = 1, 2, 3, 1
    assert np.abs(TF._normal_product(spark, rows, z) - x.T @ (x @ z)).max() < 1e-12
