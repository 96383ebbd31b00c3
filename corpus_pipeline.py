"""A corpus in five stages: language ID, exact dedup, SimHash near-dedup,
mixing to target weights, packing.

Each stage works on all rows its predecessor kept; what it keeps is written as
Parquet to the shared folder and read again by the next.  All stages take an
empty table (and give one), texts of any length, and extra columns of any name,
which all but the last return as they are; nulls in other columns than text and
doc_id are ordinary values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changelens.llm import exact, langid, mixing, packing, simhash, storage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least half of them in a script of a known
    language, stay, in however many known languages they are; the model is
    learned from about 20,000 of the labelled ones.

    Null and empty texts and those without letters go; repeated rows and ids stay
    alike; if no document has a language, all rows stay."""
    return langid.keep_identified(docs, langid.train(docs, "text", "lang", "doc_id", sample_rows=20000))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays.

    Null texts equal empty ones; null ids come last; of fully repeated rows one
    stays; a repeated id with another text is another document."""
    return exact.keep_first(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the smallest doc_id stays.

    Rows are told apart by id and text; of several texts of the smallest id one
    stays; rows with a null id have no place in a component and stay; null and
    empty texts are one component."""
    return simhash.keep_first(docs, size=3, seed=42, budget=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with calibrated probabilities, 80 % of the tokens.

    Null sources and languages are classes of their own; null and empty texts
    count one token; null ids are drawn by their text; repeated rows alike."""
    return mixing.sample(docs, budget=0.8, temper={"source": 0.7, "lang": 0.7, "topic": 0.8})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence.

    Null and empty texts are just the end id; null ids are kept; repeated rows
    are packed each on their own; other columns are left out."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = storage.cut(docs, name)
    return docs
